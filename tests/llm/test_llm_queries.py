"""Registered queries that SQL can't express, beside plain versions over whole tables."""

from __future__ import annotations

import collections
import os
import re

import pytest

from runsight.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def targets(sizes: dict) -> dict:
    """Sources by code point, null last, weigh 1, 2, 3 and so on; no target is over 3 times its source, the rest is shared anew."""
    order = sorted((name for name in sizes if name is not None), key=lambda name: [ord(c) for c in name]) + ([None] if None in sizes else [])
    weight = {name: 1 + i % 3 for i, name in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while free:
        share = {name: left * weight[name] / sum(weight[x] for x in free) for name in free}
        full = {name for name in free if share[name] > 3 * sizes[name]}
        if not full:
            return out | share
        out |= {name: 3.0 * sizes[name] for name in full}
        left -= sum(3 * sizes[name] for name in full)
        free -= full
    return out


def test_mixing_of_all_documents(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in docs.items()}
    sources = collections.Counter()
    for i, r in docs.items():
        sources[r["source"]] += size[i]
    wanted, found = targets(sources), QUERIES["op2_mixing"](spark, SF).collect()
    taken = collections.Counter()
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    for r in found:
        source = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sources[source]) and r["target"] == pytest.approx(wanted[source])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 1 + 0.01 * target
    assert sorted(map(repr, found)) == sorted(map(repr, QUERIES["op2_mixing"](spark, SF).collect()))


def test_toxicity_of_held_out_rows(spark):
    # The smaller tables hold some 40 toxic documents to learn from.
    sf = "/root/testdata/sf0.1"
    found = QUERIES["op3_toxicity"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    toxic, clean = ([r for r in found if r["toxic"] == kind] for kind in (1, 0))
    assert toxic and sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in found)
