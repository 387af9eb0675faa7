"""N-gram Jaccard join by grouped prefixes: near duplicates and their components, exactly.

A document is the set of its distinct word shingles (64-bit hashes). Sets are ordered by one global order,
rare shingles first. Two sets of sizes m <= n can only reach similarity t if m >= t n and if they share L
shingles of their prefixes, the first n - ceil(t n) + L in that order, for any L up to ceil(t m); here L is at most COMMON.

1. _levels(): how often shingles occur, as a table of fixed size by hash. It only shapes the order.
2. Documents of equal sets are one node; nodes of identical prefix and size are one group.
3. The prefix join runs on groups. Groups that share fewer than L of their prefix shingles with all others together go
   at once. Groups that share a prefix shingle are a group pair if their sizes, and the shingle's places in both,
   leave room for the similarity, and unless all nodes of both are of one component already: only links between components can still change any.
4. Group pairs that pass are expanded into pairs of nodes. Those first meet the parity filter: a node keeps the
   parity of its shingles' number in each of about as many hash buckets as it has shingles, and two sets differ
   by at least as many shingles as parities. What passes is verified on whole sets, which are written once, in buckets by node.

Group pairs are made in rounds, so that neither a shingle that many groups share nor a group of many nodes makes
all pairs of its copies. In the first rounds a shingle's groups only meet one of them, its pivot (first the one
that shares most: of near copies, the least edited), and a group's nodes only meet the pivot's smallest node, or
their own group's. The last round makes all group pairs that are left between components, by shingle and class
of size, and expands both sides; there too a node first meets one of its partners, and what that settles is dropped.

Defined results: null and empty texts, and texts without words, have no shingles, no links and their own
doc_id as component; a text of fewer words than a shingle is one shingle; rows with a null doc_id have a
null component and link nothing; repeated rows are all returned; an empty table gives no
rows; further columns, whatever their names, are ignored by linked() and kept by deduplicated().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, cut, cut_by, kept, ready, trimmed
from .graph import merged
from .words import mix, shingle_sets

SHINGLE = 5
#: similarity as per cent of the union
PER_CENT = 75
BUCKETS = 1 << 18
#: prefix shingles that alike sets share at least, if they are large enough
COMMON = 6
#: a shingle counts as frequent from so many occurrences in one task on
LOCAL_LEAST = 2
LEAST_PARITIES, MOST_PARITIES = 256, 1 << 17
#: bits of the filter that tells the pass which makes sets whose it needs: WANTED_SHARE for each node, so that few others
#: are made, and at most WANTED_BITS (16 MB), so that it can be sent to every task. Beyond, more sets are made than needed, never fewer
WANTED_SHARE, WANTED_BITS = 16, 1 << 27
#: rounds in which groups meet one pivot of each of their prefix shingles
PIVOT_ROUNDS = 3
#: sets that a task remembers having sent on, so that copies next to each other are sent once
REMEMBERED = 1 << 16


def _levels(documents: DataFrame, size: int) -> np.ndarray:
    """By hash bucket, the logarithm of how often its locally frequent shingles occur: BUCKETS bytes, whatever the input."""

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            held: list[np.ndarray] = []
            n = 0
            for _, s in shingle_sets(batch.column(0), size):
                held.append(s)
                n += len(s)
                if n > 2_000_000:
                    _count(held, total)
                    held, n = [], 0
            _count(held, total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = documents.select(F.col("text").cast("string")).mapInArrow(scan, "bucket long, n long")
    rows = found.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.uint8)
    out[rows["bucket"].to_numpy()] = np.ceil(np.log2(rows["n"].to_numpy() + 1.0)).astype(np.uint8)
    return out


def _count(held: list[np.ndarray], total: np.ndarray) -> None:
    if held:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= LOCAL_LEAST
        np.add.at(total, (values[often] >> np.uint64(46)).astype(np.int64), n[often])


def _prefix(s: np.ndarray, levels: np.ndarray, per_cent: int) -> np.ndarray:
    """The prefix of a sorted set in the global order: by level, then by hash."""
    least = -(-per_cent * len(s) // 100)
    k = len(s) - least + min(COMMON, least)
    level = levels[(s >> np.uint64(46)).astype(np.int64)]
    return s[np.argsort(level, kind="stable")[:k]]


def _node(s: np.ndarray) -> bytes:
    """The name of a set: 128 bits of its members."""
    with np.errstate(over="ignore"):
        return np.array([mix(s).sum(), mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum() + np.uint64(len(s))], np.uint64).tobytes()


def _group(prefix: np.ndarray, n: int) -> int:
    """The name of a prefix and size; its last byte is left for a place in the prefix."""
    with np.errstate(over="ignore"):
        return int((mix(prefix + np.uint64(n)).sum() & ~np.uint64(255)).astype(np.int64))


def _parity(s: np.ndarray) -> bytes:
    n = min(MOST_PARITIES, max(LEAST_PARITIES, 1 << (len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """At least so many shingles are in one set only. The longer parity is folded until both are of one length."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _documents(documents: DataFrame, levels: np.ndarray, size: int, per_cent: int) -> DataFrame:
    """doc_id, node, n, grp and parities of every row; node is null for an empty set."""
    kind = documents.select("doc_id").schema.fields[0].dataType.simpleString()

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, grp, odd = [], [], [], []
            for _, s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                node.append(_node(s) if len(s) else None)
                grp.append(_group(_prefix(s, levels, per_cent), len(s)) if len(s) else None)
                odd.append(_parity(s) if len(s) else None)
            arrays = [batch.column(0), pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(grp, pa.int64()), pa.array(odd, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "node", "n", "grp", "odd"])

    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(scan, f"doc_id {kind}, node binary, n long, grp long, odd binary")


def _shared(documents: DataFrame, levels: np.ndarray, size: int, per_cent: int) -> DataFrame:
    """(token, grp, place) of the prefix shingles that at least two groups share: the one shuffle of prefixes.

    place is the shingle's place in the global order of its set, in 256ths of the set's size, rounded down.
    """

    @trimmed
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            tokens, groups, n = [], [], 0
            for _, s in shingle_sets(batch.column(0), size):
                if not len(s):
                    continue
                prefix = _prefix(s, levels, per_cent)
                g = _group(prefix, len(s))
                if g in sent:
                    continue
                if len(sent) >= REMEMBERED:
                    sent.clear()
                sent.add(g)
                tokens.append(prefix)
                groups.append(g | np.arange(len(prefix)) * 256 // len(s))
                n += len(prefix)
                if n > 200_000:
                    yield _pairs_batch(tokens, groups)
                    tokens, groups, n = [], [], 0
            if n:
                yield _pairs_batch(tokens, groups)

    @trimmed
    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_, sent = None, None, False  # the bucket at the end of what has been read, its first group
        for batch in batches:
            if not batch.num_rows:
                continue
            t, g = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
            if last == t[0] and open_ == g[0]:
                fresh[0] = False
            keep = np.zeros(len(t), bool)
            same = t[1:] == t[:-1]
            other = same & (g[1:] != g[:-1])
            # rows of buckets with more than one group: a bucket's rows are sorted by group
            start = np.concatenate(([0], np.flatnonzero(~same) + 1))
            mixed = np.add.reduceat(np.concatenate((other, [False])).astype(np.int64), start) > 0
            # `other` at the last row of a bucket is False, so each bucket only counts its own changes
            keep |= np.repeat(mixed, np.diff(np.append(start, len(t))))
            end = start[1] if len(start) > 1 else len(t)
            if last == t[0]:
                if sent:
                    keep[:end] = True
                elif keep[0] or open_ != g[0]:
                    keep[:end] = True
                    yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([open_], pa.int64())], names=["token", "grp"])
            sent = bool(keep[-1])
            last, open_ = t[-1], g[-1]
            keep &= fresh
            yield pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(g[keep])], names=["token", "grp"])

    rows = documents.select(F.col("text").cast("string")).mapInArrow(emit, "token long, grp long")
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, "token").sortWithinPartitions("token", "grp").mapInArrow(buckets, "token long, grp long")
    return found.select("token", F.col("grp").bitwiseAND(F.lit(~255)).alias("grp"), F.col("grp").bitwiseAND(F.lit(255)).alias("place"))


def _pairs_batch(tokens: list[np.ndarray], groups: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(groups))], names=["token", "grp"])


def _filter_of(ids: DataFrame, bits: int) -> np.ndarray:
    """`bits` bits, set at the hash of each doc_id."""
    h = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("h"))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    rows = h.groupBy(F.shiftright("h", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _sets(wanted: DataFrame, documents: DataFrame, size: int) -> DataFrame:
    """(node, members) of the wanted nodes, and of some others, in buckets by node; wanted has the doc_id of one document of each."""
    n = wanted.count()
    bits = min(WANTED_BITS, max(1 << 12, 1 << (WANTED_SHARE * n - 1).bit_length()))
    wanted_bits = _filter_of(wanted, bits)

    @trimmed
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            h = batch.column(1).to_numpy()
            need = (wanted_bits[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1
            column = batch.column(0).filter(pa.array(need))
            for a in range(0, len(column), 256):
                found = {}
                for _, s in shingle_sets(column.slice(a, 256), size):
                    if len(s) and (node := _node(s)) not in sent:
                        found[node] = s.tobytes()
                if len(sent) >= REMEMBERED:
                    sent.clear()
                sent.update(found)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["node", "members"])

    texts = documents.filter("doc_id is not null").select(F.col("text").cast("string"), F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("h"))
    made = texts.mapInArrow(make, "node binary, members binary")
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_by(made.repartition(parts, "node").dropDuplicates(["node"]), "sets", "node")


def _possible(pairs: DataFrame, nodes: DataFrame, per_cent: int) -> DataFrame:
    """The distinct pairs (a, b) of nodes that the parity filter lets pass."""
    one = nodes.select("node", "n", "odd")
    both = pairs.join(one.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("odd").alias("odd_b")), "b")
    both = both.join(one.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("odd").alias("odd_a")), "a").select("a", "b", "n_a", "n_b", "odd_a", "odd_b")

    @trimmed
    def could(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = np.fromiter(map(_apart, batch.column(4).to_pylist(), batch.column(5).to_pylist()), np.int64, batch.num_rows)
            ok = apart * (100 + per_cent) <= n * (100 - per_cent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(could, "a binary, b binary")


def _verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link, by their whole sets."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b")
    both = both.join(sets.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a").select("a", "b", "ma", "mb")

    @trimmed
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.sort(np.concatenate((p, q)), kind="stable")
                common = int((z[1:] == z[:-1]).sum())
                ok.append(100 * common >= per_cent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(verify, "a binary, b binary")


def _band(n: Column, per_cent: int) -> Column:
    """The class of a size: sizes that can be alike are of one class or of two next to each other."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / per_cent))).cast("int")


def linked(documents: DataFrame, size: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    ready(documents.sparkSession)
    made = Tables()
    levels = _levels(documents, size)
    docs = made.cut(_documents(documents, levels, size, per_cent), "documents")
    firsts = [F.first(c).alias(c) for c in ("n", "grp", "odd")]
    nodes = made.cut(docs.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *firsts), "nodes")
    settled = nodes.select("node", "grp", F.col("node").alias("root"))
    groups = made.cut(nodes.groupBy("grp").agg(F.min("node").alias("rep"), F.max("node").alias("last"), F.first("n").alias("n")), "groups")

    # the prefix shingles that groups share, of groups that share enough for their smallest partner; those that the very same groups
    # share, as of one passage, are one: at the first of their places
    need = lambda n: F.least(F.lit(COMMON), F.ceil(n * per_cent / 100))
    found = made.cut(_shared(documents, levels, size, per_cent), "found")
    common = found.groupBy("grp").agg(F.count("*").alias("common")).join(groups.select("grp", "n", "rep"), "grp").filter(F.col("common") >= need(F.ceil(F.col("n") * per_cent / 100)))
    found = found.join(made.cut(common, "common"), "grp")
    lists = found.groupBy("token").agg(F.bit_xor(F.xxhash64("grp")).alias("list"))
    one = found.join(lists, "token").groupBy(F.col("list").alias("token"), "grp").agg(F.min("place").alias("place"), *[F.first(c).alias(c) for c in ("common", "n", "rep")])
    shared = made.cut(one, "shared")
    several = groups.filter("rep <> last")

    wanted = shared.select("grp").unionByName(several.select("grp")).distinct()
    sets = made.add(_sets(nodes.join(wanted, "grp", "left_semi").select("doc_id"), documents, size))

    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * per_cent
    # what a set has before its first shared shingle cannot be shared
    shares = F.ceil((F.col("n_a") + F.col("n_b")) * per_cent / (100 + per_cent))
    room = (F.col("place_a") * F.col("n_a") / 256 <= F.col("n_a") - shares) & (F.col("place_b") * F.col("n_b") / 256 <= F.col("n_b") - shares)
    members = lambda x: settled.select(F.col("grp").alias(f"grp_{x}"), F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    roots = None

    def link(pairs: DataFrame) -> None:
        """Verify pairs of nodes, a table, and bring the components up to date."""
        nonlocal roots, settled
        if pairs.isEmpty():
            return
        own = Tables()
        links = own.cut(_verified(pairs, sets, per_cent), "links")
        roots = merged(roots, links)
        own.close()
        settled = nodes.select("node", "grp").join(roots, "node", "left").select("node", "grp", F.coalesce("root", "node").alias("root"))

    for k in range(PIVOT_ROUNDS):
        own = Tables()
        spread = own.cut(settled.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")), "spread")
        at = shared.join(spread, "grp")
        open_ = at.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).filter("l <> h").select("token")
        at = own.cut(at.join(open_, "token", "left_semi"), "open")
        pick = F.min if k == PIVOT_ROUNDS - 1 else F.max
        pivots = at.groupBy("token").agg(pick(F.struct(*["common"] * (k == 0), "rep", "grp", "place", "n", "lo", "hi")).alias("p"))
        met = at.join(pivots, "token").select(*[F.col(f"p.{c}").alias(f"{c}_a") for c in ("rep", "grp", "place", "n", "lo", "hi")], *[F.col(c).alias(f"{c}_b") for c in ("grp", "place", "n", "lo", "hi")])
        met = met.filter("grp_a <> grp_b and (lo_a <> hi_a or lo_b <> hi_b or lo_a <> lo_b)").filter(fits & room).select(F.col("rep_a").alias("a"), "grp_b")
        own_group = several.join(spread.filter("lo <> hi"), "grp").select(F.col("rep").alias("a"), F.col("grp").alias("grp_b"))
        pairs = met.unionByName(own_group).distinct().join(members("b"), "grp_b").join(settled.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a")
        pairs = pairs.filter("root_a <> root_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        link(own.cut(_possible(pairs, nodes, per_cent), "candidates"))
        own.close()

    # all group pairs that are left, by shingle and class of size
    spread = made.cut(settled.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")), "spread")
    at = shared.join(spread, "grp")
    open_ = at.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).filter("l <> h").select("token")
    at = made.cut(at.join(open_, "token", "left_semi").withColumn("band", _band(F.col("n"), per_cent)), "open")
    left, right = (at.select("token", "band", *[F.col(c).alias(f"{c}_{x}") for c in ("grp", "place", "n", "lo", "hi")]) for x in "ab")
    right = right.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    across = left.join(right, ["token", "band"]).filter("grp_a < grp_b and (lo_a <> hi_a or lo_b <> hi_b or lo_a <> lo_b)").filter(fits & room).select("grp_a", "grp_b").distinct()
    within = spread.filter("lo <> hi").select(F.col("grp").alias("grp_a"), F.col("grp").alias("grp_b"))
    pairs = across.unionByName(within).join(members("a"), "grp_a").join(members("b"), "grp_b").filter("root_a <> root_b and (grp_a <> grp_b or a < b)")
    pairs = made.cut(_possible(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), nodes, per_cent), "candidates")
    link(made.cut(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "nearest"))
    for x in "ab":
        pairs = pairs.join(settled.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x)
    link(made.cut(pairs.filter("root_a <> root_b").select("a", "b"), "last"))

    if roots is not None:
        made.add(roots)
    named = made.cut(settled.join(nodes.select("node", "doc_id"), "node").select("node", "doc_id", "root"), "named")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component"))
    of_node = named.join(least, "root").select("node", "component")
    out = docs.select("doc_id", "n", "node").join(of_node, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    result = cut(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")), "linked")
    made.close()
    return result


def deduplicated(documents: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its own columns, whatever those are called.

    Rows without shingles or doc_id stay; of rows that repeat the smallest doc_id of a component all
    stay, as doc_id is what tells documents apart.
    """
    own = kept(documents)
    found = linked(documents.select("doc_id", "text"))
    gone = found.filter("component_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return own.back(own.table.join(gone, own["doc_id"] == F.col("gone"), "left_anti"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0) x
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PER_CENT} * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c LEFT JOIN n USING (doc_id)
"""
