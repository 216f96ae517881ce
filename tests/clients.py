from __future__ import annotations

from runsight.operators.inference import Completion


class Echo:
    def complete(self, messages, params):
        text = messages[-1]["content"]
        if text == "fail":
            raise RuntimeError("no answer")
        shown = "|".join(f"{m['role']}={m['content']}" for m in messages)
        return Completion(f"{shown} {sorted(params.items())}", 3, 4)


class Counted(Echo):
    """Notes each call in a file."""

    def __init__(self, path):
        self.path = path

    def complete(self, messages, params):
        with open(self.path, "a") as notes:
            notes.write("x")
        return super().complete(messages, params)


class Outage(BaseException):
    """Ends the call's task, not only its row."""


class GoesDown(Counted):
    """Is down once there were `most` calls."""

    def __init__(self, path, most):
        super().__init__(path)
        self.most = most

    def complete(self, messages, params):
        with open(self.path) as notes:
            if len(notes.read()) >= self.most:
                raise Outage
        return super().complete(messages, params)
