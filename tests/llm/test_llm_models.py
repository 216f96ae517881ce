"""Near duplicates, vectors, decontamination, toxicity, personal data: brute force and held-out accuracy."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsight.llm import decontamination, embedding_dedup, near_dup, pii, toxicity
from runsight.llm.components import connected_components

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(2))
def test_components_are_those_of_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)] + [(999, i) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    found = connected_components(spark.createDataFrame(links, "x long, y long")).collect()
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["component"] for r in found} == roots({n for link in real for n in link}, real)
    assert connected_components(spark.createDataFrame([], "x long, y long")).count() == 0


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return frozenset(zip(*[words[i:] for i in range(size)])) if len(words) >= size else frozenset([tuple(words)] if words else [])


def brute_near(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    links = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if x and y and a != b and 100 * len(x & y) >= percent * len(x | y)]
    return roots({i for i, _ in sets}, links)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def test_near_duplicates_of_large_and_small_groups(spark):
    rng = random.Random(3)
    rows, base = [], [f"w{rng.randrange(500)}" for _ in range(150)]
    rows += [(i, " ".join(edited(rng, base, rng.randrange(14)))) for i in range(60)]
    for g in range(30):
        other = [f"v{rng.randrange(10**5)}" for _ in range(rng.choice([1, 2, 3, 40, 90]))]
        rows += [(100 + 5 * g + k, " ".join(edited(rng, other, rng.randrange(4)))) for k in range(rng.randrange(1, 5))]
    rows += [(rows[0][0], rows[0][1]), (900, rows[3][1].upper()), (901, ""), (902, None), (903, " \n"), (None, rows[0][1]), (904, "  a b"), (905, "word " * 60_000), (906, "word " * 50_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"component": F.lit(1), "rep": F.lit(2), "_all": F.lit(3)})
    for size, percent in ((3, 85), (5, 80)):
        found = near_dup.near_duplicates(docs, size, percent).collect()
        want = brute_near(rows, size, percent)
        assert len(found) == len(rows)
        for r in found:
            assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["component_id"] == r["doc_id"])
        sizes = {i: len(shingles(t, size)) for i, t in rows}
        assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in found)
    kept = near_dup.distinct_documents(docs)
    assert kept.columns == docs.columns
    want = brute_near(rows, 5, 80)
    assert sorted(r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted({i for i, c in want.items() if i == c})
    assert kept.filter("doc_id IS NULL").count() == 1


def test_dense_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dup, "BLOCK_DOCUMENTS", 5)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(7)))) for i in range(70)]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_near(rows, 3, 85)


def test_near_duplicates_of_nothing_and_of_one_id(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(5, text), (5, "other words here"), (7, "other words here"), (9, text)], DOCS)
    assert {(r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(docs).collect()} == {(5, 5), (7, 5), (9, 5)}
    assert sorted((r["doc_id"], r["text"]) for r in near_dup.distinct_documents(docs).collect()) == [(5, "other words here")]


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_vectors(rows, limit=0.98):
    good = [(i, np.array(e, np.float64), l) for i, e, l in rows if i is not None and e and l is not None and None not in e and np.isfinite(e).all() and np.any(e)]
    links = collections.Counter()
    pairs = []
    for n, (a, x, k) in enumerate(good):
        for b, y, l in good[:n]:
            if k == l and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= limit:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    return links, roots({i for i, _, _ in rows if i is not None}, pairs)


@pytest.mark.parametrize("block", [7, 1500])
def test_vectors_match_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for label in range(3):
        centre = rng.standard_normal(16)
        for _ in range(40):
            noise = rng.choice([0.0, 0.05, 0.15, 0.2, 1.0])
            rows.append((len(rows), [float(v) for v in (centre + noise * rng.standard_normal(16)).astype(np.float32)], label))
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] + [1.0] * 15, 1), (504, rows[0][1], None), (505, [float("inf")] * 16, 1)]
    rows += [(506, [1.0, 2.0], 0), (507, [2.0, 4.0], 0), (508, [], 0), (None, rows[0][1], 0), (509, rows[0][1], 1)]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({"rep": F.lit(1), "_a": F.lit(1), "n": F.lit(1)})
    found = embedding_dedup.near_duplicate_vectors(frame, block=block).collect()
    links, components = brute_vectors(rows)
    assert len(found) == len(rows)
    for r in found:
        if r["vec_id"] is not None:
            assert (r["vec_id"], r["n_links"], r["component_id"]) == (r["vec_id"], links[r["vec_id"]], components[r["vec_id"]])
            assert r["kept"] == (r["component_id"] == r["vec_id"])
    assert embedding_dedup.near_duplicate_vectors(frame.limit(0)).count() == 0


def test_bounds_hold_and_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64))
    q = x[:50] + 0.3 * rng.standard_normal((50, 64))
    true = (x @ q.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(q, axis=1)
    codes, factors = embedding_dedup.encode(x)
    assert codes.shape == (400, 8)
    assert (embedding_dedup.upper_bounds(codes, factors, q) >= true).all()
    assert abs((embedding_dedup.upper_bounds(codes, factors, q, sigmas=0.0) - true).mean()) < 0.01


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest_part_is_the_least_over_all_parts():
    rng = np.random.default_rng(2)
    for _ in range(30):
        item, text = rng.integers(0, 4, 5).astype(np.uint64), rng.integers(0, 4, 9).astype(np.uint64)
        want = min(edit_distance(item, text[i:j]) for i in range(10) for j in range(i, 10))
        distance, end = decontamination.nearest_part(item, text)
        assert distance == want == min(edit_distance(item, text[i:end]) for i in range(end + 1))


def test_items_are_found_with_edits_and_clean_texts_are_not(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"i{rng.randrange(3000)}" for _ in range(rng.randrange(12, 60)))) for i in range(40)]
    prose = lambda n: [f"p{rng.randrange(3000)}" for _ in range(n)]
    rows, want = [], {}
    for i, text in items:
        words = text.split()
        for k, share in enumerate((0, 0.1, 0.2, 0.5)):
            changed = list(words)
            places = rng.sample(range(len(words)), int(len(words) * share))
            for place in sorted(places, reverse=True):
                changed[place : place + 1] = rng.choice([[], ["new"], [changed[place], "more"]])
            want[10 * i + k] = (i, edit_distance(words, changed))
            rows.append((10 * i + k, " ".join(prose(30) + [w.upper() + "," for w in changed] + prose(30))))
    rows += [(10_000, None), (10_001, ""), (None, items[0][1]), (10_002, " ".join(prose(50_000)) + " " + items[1][1])]
    docs = spark.createDataFrame(rows, DOCS).withColumn("item_id", F.lit(1))
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert (None, 0) in found and (10_002, 1) in found and found[10_002, 1]["distance"] == 0 and found[10_002, 1]["start_word"] == 50_000
    alike = {(d, i) for d, (i, distance) in want.items() if distance <= int(len(items[i][1].split()) * 0.2)}
    caught = {pair for pair in found if pair[0] is not None and pair[0] < 10_000}
    assert caught <= set((d, i) for d, (i, _) in want.items())
    assert len(alike & caught) >= 0.97 * len(alike) and not [d for d, _ in caught if d % 10 == 3]
    assert all(found[pair]["distance"] <= want[pair[0]][1] for pair in caught)
    clean = decontamination.without_items(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == docs.columns
    assert clean.count() == len(rows) - len({d for d, _ in found})


def test_items_in_several_blocks_and_none(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS_PER_BLOCK", 1)
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "a b c d e f g h i j"), (3, "too short"), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so One two three, four five six seven eight nine a b c d e f g h i j"), (2, "too short")], DOCS)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.find_items(docs, items).collect()) == [(1, 1), (1, 2)]
    assert decontamination.without_items(docs, items).select("doc_id").collect() == [(2,)]
    assert decontamination.find_items(docs, items.limit(0)).count() == 0 == decontamination.find_items(docs.limit(0), items).count()
    assert decontamination.without_items(docs, items.limit(0)).count() == 2


def test_marginals_are_those_of_plain_forward_backward():
    rng = np.random.default_rng(6)
    numbers = toxicity.Numbers({"bad": 1, "worse": 2, "ba+": 3})
    model = toxicity.Model(numbers, *rng.standard_normal((3, 4)), -1.0, rng.standard_normal((2, 2)), np.zeros(4))
    for array in (model.own, model.before, model.after):
        array[0] = 0
    for gaps in ([0, 3], [2, 0, 1, 40], [5], [300, 2]):
        words = []
        for gap in gaps:
            words += [0] * gap + [int(rng.integers(1, 4))]
        words += [0] * 4
        padded = np.array([0, *words, 0])
        emit = np.exp(np.stack([np.zeros(len(words)), model.emission(padded)], axis=1))
        moves, n = np.exp(model.moves), len(words)
        forward, backward = [emit[0] / emit[0].sum()], [np.ones(2)]
        for t in range(1, n):
            step = (forward[-1] @ moves) * emit[t]
            forward.append(step / step.sum())
            step = moves @ (emit[n - t] * backward[-1])
            backward.append(step / step.sum())
        both = np.array(forward) * np.array(backward[::-1])
        want = both[:, 1] / both.sum(axis=1)
        for place, value in model.marginals(n, [(i, w) for i, w in enumerate(words) if w]):
            assert value == pytest.approx(want[place], abs=1e-9)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.withColumns({"text": F.lit("x"), "odds": F.lit(1)}))
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, other).document == pytest.approx(model.document)
    found = toxicity.score(docs, model).join(labels.filter(toxicity.held_out(F.col("doc_id"))), "doc_id").collect()
    good = [r["score"] for r in found if r["toxic"] == 0]
    assert sum(s < 0.3 for s in good) >= 0.98 * len(good)
    assert sum(r["score"] >= 0.3 for r in found if r["toxic"] == 1) >= 0.6 * sum(r["toxic"] for r in found)
    edge = [(1, None), (2, ""), (3, "you are an IDIOT, trash and scum! stupid moron loser"), (None, "idiot " * 100_000), (3, "é idiot clown trash")]
    rows = toxicity.score(spark.createDataFrame(edge, DOCS), model).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows) and rows[0]["score"] == rows[1]["score"] < 0.3 < rows[2]["score"]
    text = edge[2][1]
    assert "IDIOT" in {text[s["start"] : s["end"]] for s in rows[2]["spans"]}
    frame = spark.createDataFrame(edge, DOCS).withColumn("_toxicity", F.lit(1))
    assert sorted(str(r["doc_id"]) for r in toxicity.less_toxic(frame, model).collect()) == ["1", "2"]
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs.limit(20), nothing).collect()} and toxicity.score(docs.limit(0), nothing).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    found = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]:
                found.append((m.start(), n, m.end()))
    return sorted(found)


def hard_texts():
    rng = random.Random(9)
    signs = ["a@b.co", "@", ".", "+", "1", "23", " ", "-", "a_", "1.2.3.4", "000000255.1.1.1", "256.1.1.1", "4111 1111 1111 1111", "+1 (222) 333-4444", "é", "\n", "x@y", "%", "\U0001f600"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(400)]


def test_base_spans_are_those_of_the_patterns(spark):
    texts = hard_texts() + [None, "", "7" * 50_000, "a" * 50_000, "1 " * 30_000, "a.b@c." * 20_000, "+" * 1000, "a@b.c_x@y.zz", "١٢ 1.2.3.4.5.6.7.8"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "a@b.cd")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"start": F.lit(1), "kind": F.lit(2), "match": F.lit(3), "spans": F.lit(4)})
    found = pii.personal_data(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        text = "a@b.cd" if r["doc_id"] is None else texts[r["doc_id"]]
        want = base_spans(text)
        got = [(s["start"], s["kind"] - 1, s["end"]) for s in r["spans"] if s["base"]]
        assert got == want, (text[:200], got, want)
        for s in r["spans"]:
            assert s["base"] or not any(a < s["end"] and s["start"] < e for a, _, e in want)
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_trees_select_by_format_and_context(spark):
    rng = random.Random(10)
    rows = []
    for i in range(600):
        number = "".join(rng.choice("0123456789") for _ in range(10))
        shown = f"+1 ({number[:3]}) {number[3:6]}-{number[6:]}"
        rows.append((i, f"Please call {shown} now, order {rng.randrange(10**9, 10**10)} is ready."))
    rows.append((9999, "Please call 1 (222) 333-4444 now."))
    found = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(sum(s["base"] for s in found[i]) == 1 for i in range(600))
    assert sum(len(found[i]) > 1 for i in range(600)) < 30


def test_loose_forms_are_selected(spark):
    rng = random.Random(10)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = [(i, f"Please call +1 ({digits(3)}) {digits(3)}-{digits(4)} or mail jo{i}@mail{i % 7}.com, order {digits(10)} is ready.") for i in range(600)]
    loose = {"1 (222) 333-4444": "phone", "(222) 333-4444": "phone", "jane (at) mail (dot) com": "email", "jane[at]mail[dot]com": "email"}
    rows += [(1000 + i, f"Please write to {text} now.") for i, text in enumerate(loose)]
    rows += [(2000, "They meet (at) home. Then they go."), (2001, "Order 7345550123 is ready.")]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    for i, (text, kind) in enumerate(loose.items()):
        start = len("Please write to ")
        assert [(s["start"], s["end"], pii.KINDS[s["kind"] - 1]) for s in found[1000 + i]] == [(start, start + len(text), kind)]
    assert found[2000] == found[2001] == []
    assert sum(len(found[i]) > 2 for i in range(600)) < 30


def test_queries_of_models(spark):
    from __spark_entry__ import queries

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries()["op4_personal_data"](spark, SF).collect():
        want = ",".join(f"{list(BASE)[k]}:{a}:{e}" for a, k, e in base_spans(docs[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    found = {(r["doc_id"], r["item_id"]) for r in queries()["op6_decontamination"](spark, SF).collect()}
    assert {(d, i["item_id"]) for d, t in docs.items() for i in items if i["text"] in t} <= found
    assert {r["doc_id"] for r in queries()["op3_toxicity"](spark, SF).collect()} == set(docs)


def test_short_items_and_unspaced_scripts_are_found(spark):
    items = [(1, "What is the capital of France?"), (2, "水的沸点在标准大气压下是多少摄氏度呢"), (3, "yes"), (4, "yes"), (5, "two words"), (6, "?!"), (7, None), (8, "seven words are in this very item"), (9, "東京")]
    texts = {
        1: "We ask: what is the capital -- of France? Nobody knows.", 2: "题目:水的沸点在标准大气压下是多少摄氏度呢?答案", 3: "The capital of France is what", 4: "oh YES, oh yes",
        5: "two\nwords and two words", 6: "Seven words are in this item", 7: None, 8: "", 9: "in this very item: SEVEN words are in this very item!", 10: "私は東京に", 11: "水的沸点在标准大气压下多少摄氏度呢",
    }
    items, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(list(texts.items()), DOCS)
    found = {(r["doc_id"], r["item_id"]): (r["distance"], r["start_word"], r["end_word"]) for r in decontamination.find_items(docs, items, least_words=1).collect()}
    assert found.pop((2, 2))[0] == 0 and found.pop((11, 2))[0] == 1
    assert found == {(1, 1): (0, 2, 8), (4, 3): (0, 1, 2), (4, 4): (0, 1, 2), (5, 5): (0, 0, 2), (9, 8): (0, 4, 11), (10, 9): (0, 2, 4)}
    assert sorted(r["doc_id"] for r in decontamination.without_items(docs, items).collect()) == [3, 4, 5, 6, 7, 8, 10]


def test_many_items_take_one_scan(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(3000)], k=rng.randint(2, 20))) for _ in range(20_000)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {texts[i]} after") for i in range(0, 20_000, 400)], DOCS)
    found = decontamination.find_items(docs, items, least_words=1)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    exact = {(r["doc_id"], r["item_id"]) for r in found.collect() if r["distance"] == 0}
    assert {(i, i) for i in range(0, 20_000, 400)} <= exact


def test_large_and_tiny_vectors_are_compared_by_their_direction(spark):
    rows = [(1, [1e200, 0.0], 0), (2, [2e200, 0.0], 0), (3, [1e-200, 0.0], 0), (4, [3.0, 0.0], 0), (5, [0.0, 5e-324], 0), (6, [0.0, 1.7e308], 0), (7, [0.0, 0.0], 0), (8, [1e308, 1e308], 0), (9, [2.0, 2.0], 0)]
    found = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: (r["component_id"], r["n_links"]) for r in found} == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (1, 3), 5: (5, 1), 6: (5, 1), 7: (7, 0), 8: (8, 1), 9: (8, 1)}


def test_one_id_with_many_rows_is_one_row_of_the_toxicity_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i} of many") for i in range(300)] + [(1, None), (3, "other"), (None, "x")], DOCS)
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    seen = []
    plain = toxicity._training_set
    try:
        toxicity._training_set = lambda rows, reach: seen.extend(rows) or plain(rows, reach)
        toxicity.fit(docs, labels)
    finally:
        toxicity._training_set = plain
    assert sum(row["toxic"] == 0 for row in seen) <= 1 and len(seen) <= 2


def test_numbers_beside_others_are_found_and_hex_words_left_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    added = pii.personal_data(docs).select("doc_id", F.explode("spans").alias("s")).filter("NOT s.base").join(docs.select("doc_id", "text"), "doc_id").collect()
    found = {(r["doc_id"], pii.KINDS[r["s"]["kind"] - 1], r["text"][r["s"]["start"] : r["s"]["end"]]) for r in added}
    assert {(1377, "phone", "+1 (826) 555-4081"), (7052, "phone", "+1 (843) 555-7672"), (46, "card", "7536784127813050"), (46, "card", "4845168114407329")} <= found
    for r in added:
        around = r["text"][max(0, r["s"]["start"] - 1) : r["s"]["end"] + 1]
        assert not around[0].isalnum() or r["s"]["start"] == 0 or around[0] in "+("
        assert not around[-1].isalnum() or r["s"]["end"] == len(r["text"])
    assert len(found) < 20


def test_personal_data_is_learnt_from_all_candidates(spark, monkeypatch):
    docs = spark.range(12_000).selectExpr("id AS doc_id", "concat('call +49 30 ', 1000000 + id, ' or ', 10000 + id, '-', id % 10, ', ref 12.', id, '.300.7') AS text")
    kept = {}
    stage = pii.stage
    monkeypatch.setattr(pii, "stage", lambda df, name, **options: kept.setdefault(name, stage(df, name, **options)))
    found = stage(pii.candidates(docs), "found")
    pii.fit(found)
    chosen = next(iter(kept.values()))
    assert chosen.filter("base AND kind = 'phone'").count() == found.filter("base AND kind = 'phone'").select("match", "before", "after").distinct().count() == 12_000
