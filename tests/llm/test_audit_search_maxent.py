"""Filter audit, ranked search and the language model against brute force, and their defined results for odd rows."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factlake.llm import audit, maxent, search
from factlake.llm.common import Tables, ready

DOC = "doc_id long, text string, lang string, source string, n_chars long, mask string, part string, rank string, score string, block string"
WORDS = "the of and that with from house river stone light water paper green small early quiet token Été über".split()
LOWER = {ord(c): c.lower() for c in audit.UPPER}


@pytest.fixture(scope="module")
def docs(spark):
    """Random texts, a large group of copies, nulls, empty and long texts, repeated rows, null ids; further columns with clashing names."""
    ready(spark)
    r = random.Random(11)
    texts = [" ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(r.choice((2, 9, 90, 260)))) for _ in range(150)]
    texts += [texts[3]] * 300 + ["", None, " \n\t", "ALL CAPS HERE", "a|b", "x" * 20_000, " ".join(f"w{i % 701}" for i in range(5000)), texts[9].upper()]
    rows = [(i, t, ("en", "fr", None, "")[i % 4], "s", 1, "m", "p", "r", "s", "b") for i, t in enumerate(texts)]
    rows += [rows[5]] * 3 + [(None, texts[3], "en", "s", 1, "", "", "", "", ""), (None, None, None, None, None, None, None, None, None, None), (3000, texts[7], "en", "s", 1, "", "", "", "", "")]
    r.shuffle(rows)
    return spark.createDataFrame(rows, DOC).repartition(7).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, 400, 2)] + [(4, 1, 1), (None, 1, 1), (77777, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


def failures(text, text_ids, doc_id):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
    out["E"] = doc_id is not None and any(i < doc_id for i in text_ids[text])
    return {x for x, y in out.items() if y}


def test_audit_is_brute_force(docs, labels):
    rows = [(x.doc_id, x.text or "", x.lang or "") for x in docs.collect()]
    ids, good, toxic = collections.defaultdict(set), set(), set()
    for i, t, _ in rows:
        ids[t] |= set() if i is None else {i}
    for x in labels.collect():
        good |= {x.doc_id} if x.quality == 1 else set()
        toxic |= {x.doc_id} if x.toxic == 1 else set()
    own = [(i, part, failures(t, ids, i)) for i, t, part in rows]
    want = {}
    for order in itertools.permutations("ABCDE"):
        for k, x in enumerate(order):
            for part in {p for _, p, _ in own}:
                mine = [(i, f) for i, p, f in own if p == part]
                gone = [bool(f & set(order[:k])) for _, f in mine]
                removed = [i for (i, f), g in zip(mine, gone) if x in f and not g]
                want[part, "".join(order), k + 1] = [
                    sum(not g and x not in f for (_, f), g in zip(mine, gone)), len(removed), sum(g and x in f for (_, f), g in zip(mine, gone)), sum(f == {x} for _, f in mine),
                    sum(i in good and i is not None for i in removed), sum(i in toxic and i is not None for i in removed), sum(120 // len(f) for _, f in mine if x in f),
                ]
    got = audit.audit(docs, labels, "lang", audit.text_filters(F.col("text"))).collect()
    assert {(x.part, x.filter_order, x.step): list(x[3:]) for x in got} == want and len(got) == len(want)


def test_copies_over_range_boundaries(spark, docs, labels, none):
    """A group of copies in many ranges has one document that stays; small batches, and one partition, give the same."""
    same = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 < 4, "one text").otherwise(F.concat(F.lit("t"), F.col("id") % 7)).alias("text"), F.lit("en").alias("lang"))
    tables = Tables()
    found = {}
    for parts, batch in ((1, 10_000), (31, 10_000), (31, 7)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            m = audit.masks(same, "lang", {"A": F.col("text").isNull()}, "E", tables).filter("mask = 0").select("doc_id").collect()
            found[parts, batch] = sorted(x.doc_id for x in m)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.enabled")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    tables.close()
    assert set(map(tuple, found.values())) == {(0, *range(4, 35, 5))}
    assert audit.audit(none, labels, "lang", audit.text_filters(F.col("text"))).count() == 0


def ranked(rows, items, k):
    docs = [(i, re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for i, t in rows]
    docs = [(i, collections.Counter(t)) for i, t in docs if t]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        terms = set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))
        found = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows, fan, first", [(1024, 32, 3), (20, 4, 1), (3, 2, 2)])
def test_search_is_brute_force(spark, docs, none, monkeypatch, rows, fan, first):
    monkeypatch.setattr(search, "RANGE_ROWS", rows)
    r = random.Random(3)
    items = [(k, " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(r.choice((1, 4, 30))))) for k in range(25)]
    items += [(100, None), (101, ""), (102, "nowhere zzz"), (103, "THE1 the1 Été4"), (103, "of2"), (None, "w5 w6 w700"), (104, docs.filter("length(text) > 300").first().text)]
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, rank string, query string")
    given = [(x.doc_id, x.text) for x in docs.collect()]
    found = search.index(docs)
    want = ranked(given, items, 10)
    got = sorted(map(tuple, search.search(found, table, first=first).collect()), key=repr)
    assert got == want
    if rows == 20:  # queries in several blocks, other numbers of results
        assert sorted(map(tuple, search.search(found, table, first=first, block_chars=400).collect()), key=repr) == want
        assert sorted(map(tuple, search.search(found, table, k=3).collect()), key=repr) == ranked(given, items, 3)
        assert search.search(found, table.limit(0)).count() == 0 and search.search(search.index(none), table).count() == 0


def test_search_opens_few_nodes(spark):
    """Ranges and nodes whose bound is below the threshold stay closed; one with an equal bound is opened for its smaller doc_id."""
    rows = [(i, "common " + ("rare " * 3 if i in (700, 5) else "") + "filler " * (i % 3)) for i in range(1000, -1, -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = search.search(search.index(docs), spark.createDataFrame([(1, "rare common")], "item_id long, text string"), k=1).collect()
    assert [tuple(x)[:3] for x in got] == [tuple(x)[:3] for x in ranked(rows, [(1, "rare common")], 1)]
    queries = search.block([(1, "rare common")])
    table = search.index(docs).table.collect()[0]
    weight = np.array([1000, 1000])
    o = search.Opened(table.m, table.terms, table.df, table.ordinals, table.tf, queries, weight)
    best = []
    o.search(queries.term, 1, best, pa.array(table.doc_id))
    over = sum(o.tree(t)[0] for t in range(2))
    seen = np.flatnonzero(over >= -best[0][0])
    assert len(best) == 1 and 1 <= len(seen) < o.nodes / 4


def told(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "\0"]


def out_of_training():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2


def test_language_model_base_is_brute_force(spark, docs, none, monkeypatch):
    monkeypatch.setattr(maxent, "BLOCK_TOKENS", 3000)
    monkeypatch.setattr(maxent, "RUN", 700)
    rows = [(x.doc_id, told(x.text)) for x in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in rows if not held(i) for w in t)
    total, distinct = sum(c.values()), len(c)
    got = maxent.language_model(docs, out_of_training()).collect()
    want = sorted([(str(i), held(i), len(t), sum(c[w] > 0 for w in t), total, round(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in t), 5)) for i, t in rows])
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 5)) for x in got) == want
    assert all(x.score < 0 for x in got) and len({x.score for x in got if x.doc_id == 5}) == 1
    out = [x for x in got if x.held_out]
    assert sum(x.score for x in out) > 0.9 * sum(x.base_score for x in out)
    assert maxent.language_model(none, out_of_training()).count() == 0
    untaught = maxent.language_model(docs.limit(5), F.lit(True)).collect()
    assert len(untaught) == 5 and all(x.train_tokens == 0 and x.n_known == 0 and x.base_score == 0 and math.isfinite(x.score) for x in untaught)


def test_language_model_sums_to_one_and_learns(spark):
    """Every context's outcomes sum to one; the first update is as counted token by token; each update helps on texts held out."""
    r = random.Random(5)
    after = {w: r.sample(WORDS, 3) for w in WORDS}

    def text():
        out = [r.choice(WORDS)]
        while r.random() > 0.02:
            out.append(r.choice(after.get(out[-1], WORDS)) if r.random() < 0.9 else f"{r.choice(WORDS)}{r.randrange(2000)}")
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(1500)], "doc_id long, text string")
    blocks = maxent.encoded(docs, out_of_training())
    words = maxent.vocabulary(blocks, 4).cache()
    zero = maxent.untrained(blocks, words, 1 << 10)
    size = [len(told(x.text)) for x in docs.collect()]
    assert zero.total == sum(n for i, n in enumerate(size) if zlib.crc32(str(i).encode()) % 7 != 2) == zero.in_leaf.sum()
    counts = maxent.counts_by_block(blocks, words, 4).cache()
    means = []
    model = zero
    for k in range(3):
        got = maxent.scored(blocks, counts, model).filter("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0]
        means.append(got)
        before, model = model, maxent.updated(blocks, model, k == 0)
    assert means[0] + 0.2 < means[1] < means[2]
    # the outcomes of one context
    row = blocks.collect()[0]
    b = maxent.Block(np.array([3]), np.array([False]), np.frombuffer(row.terms, np.uint64), np.frombuffer(row.ending, np.uint16), np.array([1, 2, 3]), np.ones(3, bool))
    _, features = next(maxent.contexts(b))
    leaves = np.arange(256)
    repeated = [np.repeat(f[2:], 256) for f in features]
    _, (e1, z1), (e2, z2) = next(maxent.probabilities(model, leaves, *maxent.rows_of(repeated, leaves >> 4, 1 << 10)))
    p = np.exp(z1[leaves, leaves >> 4]) / e1.sum(1) * np.exp(z2[leaves, leaves & 15]) / e2.sum(1)
    assert abs(p.sum() - 1) < 1e-4
    n = collections.Counter()
    share = np.zeros(256)
    for x in words.collect():
        terms, ending, c = np.frombuffer(x.terms, np.uint64), np.frombuffer(x.ending, np.uint16), np.frombuffer(x.n, np.int64)
        leaf = zero.classes.of(terms, ending)
        np.add.at(share, leaf, 10 ** maxent.log_within(zero, leaf, c))
        n.update(leaf.tolist())
    unknown = 10 ** maxent.log_within(zero, np.arange(256), np.zeros(256, int))
    assert np.allclose((share + unknown)[list(n)], 1, atol=1e-6)
    # the first update, token by token, for the feature "word before"
    observed = np.zeros((1 << 10, 16))
    for row in blocks.collect():
        b = maxent.read(*[pa.scalar(row[c]) for c in maxent._READ])
        leaf = zero.classes.of(b.terms, b.ending)
        ids, at = list(b.ids), 0
        for size_, out in zip(b.size, b.held):
            own = [int(i) for i in ids[at : at + size_]]
            at += size_
            if out:
                continue
            h = [int(b.terms[i]) for i in own]
            for t in range(len(own)):
                w = [h[t - k] if t >= k else 0 for k in (1, 2, 3)]
                odd = 0x9E3779B97F4A7C15
                keys = [w[0] + 1, w[1] + 2, w[2] + 3, w[0] * odd + w[1], w[2] * odd + w[0] + 5]
                for key in maxent.mix(np.array([x % 2**64 for x in keys], np.uint64)):
                    observed[int(key) & 1023, leaf[own[t]] >> 4] += 1
    expected = observed.sum(1, keepdims=True) * np.exp(zero.outer)
    some = maxent.FIRST_SMOOTHING * expected / np.maximum(expected.sum(1, keepdims=True), 1e-9) + 1e-6
    want = maxent.FIRST_STEP * np.log((observed + some) / (expected + some))
    assert np.allclose(maxent.updated(blocks, zero, True).w1, want, atol=1e-3)
