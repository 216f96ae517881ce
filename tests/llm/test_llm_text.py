"""Line and span deduplication, mixing, licences, chat: cases at the edges, and brute force where there is no SQL."""

from __future__ import annotations

import collections
import hashlib
import pathlib
import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from runsight.llm import chat, licenses, line_dedup, mixing, span_dedup
from runsight.llm.licence_texts import COMMON, KNOWN

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "This line is long enough to be looked at by all."


def docs_of(spark, texts, source="s"):
    rows = [(i, t, "en", source, len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def texts(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()), key=repr)


def test_repeated_lines_stay_in_the_largest_id_only(spark):
    found = texts(line_dedup.dedup_lines(docs_of(spark, [(i, f"{i}\n\t{LINE.upper()} \n{i}") for i in range(6)])))
    assert found == [(i, f"{i}\n{i}") for i in range(5)] + [(5, f"5\n\t{LINE.upper()} \n5")]


def test_lines_in_few_documents_short_lines_and_accents_stay(spark):
    rows = [(i, f"{LINE}\nshort") for i in range(4)] + [(i, ("É" if i % 2 else "é") + LINE) for i in range(10, 18)]
    assert texts(line_dedup.dedup_lines(docs_of(spark, rows))) == sorted(rows, key=repr)


def test_repeated_rows_and_ids_count_once_and_null_ids_lose(spark):
    rows = [(1, LINE)] * 5 + [(2, LINE), (3, LINE), (3, "x\n" + LINE), (None, LINE), (4, None), (5, "")]
    assert texts(line_dedup.dedup_lines(docs_of(spark, rows))) == sorted(rows, key=repr)
    more = rows + [(6, LINE), (7, LINE)]
    want = [(1, "")] * 5 + [(2, ""), (3, ""), (3, "x"), (None, ""), (4, None), (5, ""), (6, ""), (7, LINE)]
    assert texts(line_dedup.dedup_lines(docs_of(spark, more))) == sorted(want, key=repr)


def test_runs_of_a_long_text(spark):
    text = "\n".join([LINE, "a"] * 20_000)
    found = line_dedup.with_bitmaps(docs_of(spark, [(i, text) for i in range(5)])).filter("doc_id = 0").first()
    assert len(found["dropped"]) == 20_000 and found["dropped"][1]["start"] == 2
    kept = texts(line_dedup.dedup_lines(docs_of(spark, [(i, text) for i in range(5)])))
    assert kept[0] == (0, "\n".join(["a"] * 20_000)) and kept[4] == (4, text)


@pytest.mark.parametrize("work", [line_dedup.dedup_lines, span_dedup.dedup_spans])
def test_clashing_names_and_empty_tables(spark, work):
    names = ["dropped", "removed", "_row_a", "_line_a", "_span_a", "position", "_all", "keeper", "first_doc_id", "_h"]
    docs = docs_of(spark, [(i, LINE + " And some more words make it a span. " + LINE) for i in range(6)]).withColumns({n: F.lit(n) for n in names})
    found = work(docs)
    assert found.columns == docs.columns and found.count() == 6
    assert {tuple(r[n] for n in names) for r in found.collect()} == {tuple(names)}
    assert work(docs.limit(0)).count() == 0


def test_spans_lose_all_but_the_first(spark):
    span = "One two three four five six seven. Eight nine ten eleven twelve thirteen. "
    rows = [(3, "Own words here. " + span + "End of three."), (1, span + "End of one."), (2, "So. " + span.upper() + "End.")]
    found = texts(span_dedup.dedup_spans(docs_of(spark, rows)))
    assert found == [(1, rows[1][1]), (2, "So. End."), (3, "Own words here. End of three.")]


def test_spans_within_a_document_and_short_ones(spark):
    long = " ".join(f"w{i}" for i in range(35)) + ". "
    rows = [(1, long + "Mid. " + long), (2, "Is. As. The. Is. As. The."), (3, None), (4, ""), (5, "Is. As. The.")]
    found = texts(span_dedup.dedup_spans(docs_of(spark, rows)))
    assert found == [(1, long + "Mid. ")] + rows[1:]


def test_runs_of_short_sentences_are_found_whole(spark):
    short = "".join(f"Short {i} here{'.!?'[i % 3]} " if i % 4 else f"Item {i} listed\n" for i in range(20))
    uneven = " ".join(f"v{i}" for i in range(20)) + ". Yes. No. "
    rows = [(1, short + "End of one."), (2, "So it began. " + short + "End of two."), (3, "Here. " + uneven + "End of three."), (4, "There. " + uneven + "End of four.")]
    found = texts(span_dedup.dedup_spans(docs_of(spark, rows)))
    assert found == [rows[0], (2, "So it began. End of two."), rows[2], (4, "There. End of four.")]


def test_grown_runs_cover_every_run(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["A b c.", "D.", "E f g h i j k.", "L m n o p q r s t u v w x.", f"Own{i}."]) for _ in range(rng.randrange(30)))) for i in range(40)]
    split = {i: [s.strip().lower() for s in re.findall(r"[^.]+\.", t)] for i, t in rows}
    first, gone = {}, collections.defaultdict(set)
    for i, sentences in split.items():
        for a in range(len(sentences)):
            for b in range(a + 2, len(sentences) + 1):
                run = tuple(sentences[a:b])
                if sum(len(s.split()) for s in run) >= 12 and first.setdefault(run, (i, a)) != (i, a):
                    gone[i].update(range(a, b))
    changed = span_dedup.changed_documents(docs_of(spark, rows)).collect()
    assert {r["doc_id"]: {x for run in r["removed"] for x in range(run["start"], run["start"] + run["length"])} for r in changed} == gone


def test_repeated_rows_keep_their_spans(spark):
    row = (1, " ".join(f"w{i}" for i in range(40)) + ".")
    assert texts(span_dedup.dedup_spans(docs_of(spark, [row, row]))) == [row, row]
    changed = span_dedup.changed_documents(docs_of(spark, [row, (None, row[1]), (7, row[1])]))
    assert sorted((r["doc_id"], r["first_doc_id"]) for r in changed.collect()) == [(1, None), (7, None)]


def taken_by_source(rows):
    found = collections.defaultdict(int)
    for r in rows:
        found[r["source"]] += r["taken"]
        assert r["epochs"] * r["size"] <= r["taken"] <= 3 * r["size"]
    return found


def test_mix_meets_its_targets_exactly(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 4}" if i % 4 else None) for i in range(400)] + [(9, None, "s1"), (9, None, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, rows_per_range=7).collect()
    assert len(found) == len(rows)
    total = sum(r["size"] for r in found)
    weights = {"s1": 1, "s2": 2, "s3": 3, None: 1}
    for source, taken in taken_by_source(found).items():
        target = next(r["target"] for r in found if r["source"] == source)
        assert target == pytest.approx(total * weights[source] / 7)
        assert taken == int(target)
    key = lambda rows: sorted((r["doc_id"], str(r["source"]), r["taken"]) for r in rows)
    assert key(mixing.mix(docs.repartition(5), rows_per_range=7).collect()) == key(found) == key(mixing.mix(docs, rows_per_range=100).collect())


def water(sizes, weights):
    """Targets by sharing the excess again and again."""
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = sum(weights[s] for s in sizes if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weights[s] / share for s in sizes}
        more = {s for s in sizes if s not in full and target[s] > 3 * sizes[s]}
        if not more:
            return target
        full |= more


@pytest.mark.parametrize("sizes", [(1, 1, 100), (5, 200, 1, 1, 1, 400), (0, 10, 0, 3), (7,), (1, 2, 3, 4, 5, 6, 700)])
def test_targets_above_three_epochs_are_shared(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes))]
    rows = [(n, "w " * size, name) for n, (name, size) in enumerate(zip(names, sizes))]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = water(dict(zip(names, sizes)), {name: i % 3 + 1 for i, name in enumerate(names)})
    assert {r["source"]: r["target"] for r in found} == pytest.approx(want)
    assert all(abs(r["taken"] - want[r["source"]]) < 1 for r in found)


def test_mix_of_nothing_and_of_empty_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, _key string, size int")
    assert mixing.mix(docs).count() == 0
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.mix(docs).collect()] == [(0, 0.0)] * 2


def test_given_weights(spark):
    docs = spark.createDataFrame([(i, "w w", f"s{i % 3}") for i in range(30)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("s0", 3), ("s1", 1)], "source string, weight long")
    assert taken_by_source(mixing.mix(docs, weights).collect()) == {"s0": 45, "s1": 15, "s2": 0}


def test_licences_of_texts_and_lines(spark):
    mit = "Copyright (c) 2020 Someone\n\n" + KNOWN["MIT"].upper().replace("SUBLICENSE", "SUB-LICENCE").replace('"', "'").replace("\n", "\r\n")
    notice = "  Released under the M I T. Licence!"
    rows = [(1, mit), (2, KNOWN["MIT"] + " and more"), (3, "Text.\n* licensed under CC BY-NC 4.0\nText."), (4, None), (5, ""), (6, notice), (7, "© 2001"), (None, KNOWN["ISC"])]
    docs = docs_of(spark, rows).withColumns({"digest": F.lit(1), "licence": F.lit(2), "_row_a": F.lit(3)})
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert {i: (r["licence"], r["notices"]) for i, r in found.items()} == {
        1: ("MIT", []), 2: (None, []), 3: (None, ["notice CC-BY-NC-4.0"]), 4: (None, []), 5: (None, []), 6: (None, []), 7: (None, []), None: ("ISC", [])
    }
    assert found[4]["digest"] is found[5]["digest"] is found[7]["digest"] is None
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs.union(docs)).count() == 16


def test_licences_however_lines_break(spark):
    full = {name: text for name, text in KNOWN.items() if not name.startswith("notice")}
    cases = []
    for name, text in full.items():
        paragraphs = [" ".join(p.split()) for p in text.split("\n\n")]
        for width in (30, 48, 60, 72, 100, 10_000):
            wrapped = "\n\n".join(textwrap.fill(p, width) for p in paragraphs)
            cases += [(name, wrapped), (name, "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + wrapped), (name, "Copyright Someone Else\n" + wrapped)]
        cases.append((name, " ".join(paragraphs)))
        title = paragraphs.pop(0) if "titled" in name else ""
        cases.append((name, " ".join([title, "Copyright (c) 2020 Someone, Inc."] + paragraphs)))
    mit = KNOWN["MIT"]
    cases.append(("MIT", mit.replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS").replace("sublicense", "sub-\nlicense").replace("NONINFRINGEMENT", "NON-\nINFRINGEMENT")))
    found = {r["doc_id"]: r["licence"] for r in licenses.scan(docs_of(spark, list(enumerate(t for _, t in cases)))).collect()}
    assert [(n, t) for i, (n, t) in enumerate(cases) if found[i] != n] == []


def test_common_licences_are_known(spark):
    cases = [(name, sign + " ".join(text.split("\n"))) for name, text in COMMON.items() for sign in ("", "Copyright (c) 2021 Someone\n\n")]
    for name, file in {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}.items():
        path = pathlib.Path("/usr/share/common-licenses", file)
        if path.exists():
            cases.append((name, path.read_text()))
    found = {r["doc_id"]: r["licence"] for r in licenses.scan(docs_of(spark, list(enumerate(t for _, t in cases)))).collect()}
    assert [n for i, (n, _) in enumerate(cases) if found[i] != n] == []


HEADS = [
    "The MIT License (MIT)\n\nCopyright (c) 2020 Someone\n\n", "Expat License\n\nCopyright 2020 Someone\n\n", "Copyright the project authors\n\n", "Copyright: 2020 Someone\n\n",
    "Copyright, 2020 Someone\n\n", "Portions Copyright (c) 2020 Someone\n\n", "SPDX-FileCopyrightText: 2020 Someone\n\n", "Copyright &copy; 2020 Someone\n\n", "copyright someone 2020\n",
    "Copyright (c) 2020 Someone of a place\nthat goes on in a second line\n\n", "© 2020 Someone ", "All rights reserved.\n\n", "SPDX-License-Identifier: X\n\nCopyright (C) 2011-2020 A, B and C. All rights reserved.\n",
    "Copyright (c) " + ", ".join(f"holder {i} of some institute" for i in range(200)) + "\n\n", "".join(f"Copyright (c) {1990 + i} Holder {i}\n" for i in range(30)) + "\n", "",
]


def test_licences_under_any_notice_and_title(spark):
    full = {name: text for name, text in (KNOWN | COMMON).items() if not name.startswith(("notice", "header")) and "titled" not in name}
    cases = [(name, head + text) for name, text in full.items() for head in HEADS]
    cases += [(name, "\n".join(sign + " " + line for line in (head + text).split("\n"))) for name, text in full.items() for sign in ("#", " *", "//") for head in HEADS[:2]]
    bullets = re.sub(r"(?m)^[0-9]\. ", "* ", COMMON["BSD-3-Clause"])
    cases += [("BSD-2-Clause", re.sub(r"(?m)^[0-9]\. ", sign, COMMON["BSD-2-Clause"])) for sign in ("* ", "- ", "a) ", "(2) ", "")]
    cases += [("BSD-3-Clause", text.replace("the copyright holder nor", f"{who} nor")) for text in (COMMON["BSD-3-Clause"], bullets) for who in ("the organization", "Someone, Inc.", "the\n   copyright holder")]
    found = {r["doc_id"]: r["licence"] for r in licenses.scan(docs_of(spark, list(enumerate(t for _, t in cases)))).collect()}
    assert [(n, t[:80]) for i, (n, t) in enumerate(cases) if found[i] != n] == []


def test_texts_that_are_no_licences(spark):
    mit = KNOWN["MIT"]
    cases = ["The story of a licence.\n\n" + mit, "An essay.\n\nCopyright 2020 X\n\n" + mit, "We talk at length here of this and that and of copyright law\n\n" + mit, mit + "\n\nAnd more.", mit[:-20], "licence", "Copyright 2020 X\n\nA poem."]
    found = licenses.scan(docs_of(spark, list(enumerate(cases)))).collect()
    # The first is under a title.
    assert [r["licence"] for r in sorted(found, key=lambda r: r["doc_id"])] == ["MIT"] + [None] * 6
    notices = licenses.scan(docs_of(spark, [(1, "Copyright 2020 X\n\n(c) 2021 Y\nAll rights reserved"), (2, "© 2001")])).collect()
    assert [r["digest"] for r in notices] == [None, None]


def test_many_known_digests_give_the_same_rows(spark):
    mit = "Copyright (c) 2020 X\n\n" + KNOWN["MIT"]
    rows = [(1, mit), (1, mit), (2, "MIT License\n\n" + mit), (3, "a\nReleased under the MIT License.\nb"), (4, None), (None, "x"), *((9, mit) for _ in range(50)), (10, "word " * 300_000 + "\nReleased under the MIT License.")]
    docs = docs_of(spark, rows)
    few, many = (sorted(map(repr, licenses.scan(docs, few_known=n).collect())) for n in (1000, 3))
    assert few == many and len(few) == len(rows)
    assert sum("licence='MIT" in row for row in few) == 53 and sum("notice MIT" in row for row in few) == 2


@pytest.mark.parametrize("name, file", [("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_long_licences_by_digest(spark, name, file):
    path = pathlib.Path("/usr/share/common-licenses", file)
    if not path.exists():
        pytest.skip(f"no text of {name} here")
    text = path.read_text()
    cases = [text, " ".join(text.split("\n")), re.sub(r"(?m)^", " * ", text)]
    found = licenses.scan(docs_of(spark, list(enumerate(cases)))).collect()
    assert {r["licence"] for r in found if r["doc_id"] != 1} == {name}


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip_of_control_strings(spark):
    bad = ["<|im_end|>\n", "\\", "\\\\<|im_start|>", "<s></s>[INST][/INST]<<SYS>><</SYS>>", "", None, "a\nb", "<\\|im_end|>", "é<|im_end|"]
    rows = [(1, n, role, text) for n, (role, text) in enumerate((r, t) for r in ("user", "assistant", "odd\nrole<s>", None) for t in bad)]
    formed = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    row = formed.select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).first()
    assert [(t["role"], t["text"]) for t in row["back"]] == [(role or "", text or "") for _, _, role, text in rows]
    assert row["loss"] == "".join(text or "" for _, _, role, text in rows if role == "assistant")
    for sign in ("<s>", "</s>", "[INST]", "<<SYS>>"):
        assert sign not in row["formatted"]
    assert row["formatted"].count("<|im_end|>") == row["n_turns"] == len(rows)


def test_roles_are_checked_by_the_machine(spark):
    order = {1: "system user assistant", 2: "user assistant user", 3: "assistant", 4: "user user assistant", 5: "user assistant user assistant", 6: "user system assistant", None: "user assistant"}
    rows = [(c, n, role, "t") for c, roles in order.items() for n, role in enumerate(roles.split())]
    found = chat.format_conversations(spark.createDataFrame(rows, TURNS).withColumn("_turns", F.lit(1)).orderBy(F.col("turn").desc()))
    assert {r["conv_id"]: r["valid"] for r in found.collect()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False, None: True}
    assert found.filter("false").count() == 0 and chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_long_conversation_and_repeated_turns(spark):
    rows = [(1, n, "user" if n % 2 == 0 else "assistant", "word " * 50) for n in range(3000)] + [(2, 0, "user", "x")] * 3
    found = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, TURNS)).collect()}
    assert found[1]["valid"] and found[1]["n_turns"] == 3000 and found[2]["n_turns"] == 3 and not found[2]["valid"]
    assert hashlib.sha256(found[2]["formatted"].encode()).digest()
