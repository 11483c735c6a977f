"""Near copies of the pipeline: all pairs of Jaccard similarity 0.8 or more over five-word shingles.

SimHash comes first: fingerprints and their pigeonhole join as in simhash link texts, and an exact
check drops links under the similarity. What fingerprints can't tell is then found by prefix
filtering, without loss. Under any one order of shingles, two sets of similarity s share a
shingle among the first n - ceil(s n) + 1 of each. The order is by hash, but shingles that lead many
texts come last; all documents are counted for that, and it affects the work alone. Texts that share
a leading shingle are compared: in rounds, each with some of them, then those that are still in
different components with each other. The places of the first shingle that two sets share, and
parities of the shingles in hash buckets, bound the difference of two sets from below and so rule
out most pairs; the others are compared by their whole sets. All groups are rows of joins, never one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm import simhash
from kinfold.llm.common import BITMAP_BITS, WHITE_SPACE, bitmap, hex_sha256, marked_by, packed, pieces, restrict, scratch, stored, unpacked
from kinfold.llm.components import components

SHINGLE_WORDS = 5
#: Least similarity, as a fraction.
OVER, UNDER = 4, 5
#: A shingle that leads more texts than this is crowded and comes last in the order.
CROWD = 30
#: Leading shingles that are counted, as a multiple of those that will lead.
WIDER = 1.5
#: Members of a group that all others are compared with in each of so many rounds; in between, what is linked is merged.
PIVOTS, ROUNDS = 8, 1
#: Earlier shared leading shingles that a member keeps: two members are not compared again where they have one of these in common.
EARLIER = 4
#: Longs into which the parities are folded for a first comparison.
FOLDS = 4
#: Bytes of text that are turned into words at once.
CHUNK_BYTES = 1 << 20

_INSIDE = np.ones(256, bool)
_INSIDE[list(WHITE_SPACE)] = False
_POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64))
_FACTORS = np.cumprod(np.full(SHINGLE_WORDS, 0xD6E8FEB86659FD93, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hash_words(raw: np.ndarray) -> np.ndarray:
    inside = _INSIDE[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    place = (np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) & 1023
    found = _mix(np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place], np.cumsum(lengths) - lengths))
    for k in np.flatnonzero(lengths > 1024).tolist():
        found[k] = xxhash.xxh64_intdigest(raw[starts[k] : starts[k] + lengths[k]].tobytes())
    return found


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the different shingles; A-Z are lower-cased, words are split at ASCII white space.

    A text of fewer words is one shingle; a text without words has none.
    """
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    parts, at = [], 0
    while at < len(raw):
        to = min(len(raw), at + CHUNK_BYTES)
        while to < len(raw) and _INSIDE[raw[to]]:  # never inside a word
            to += 1
        parts.append(_hash_words(raw[at:to]))
        at = to
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(words):
        return words
    size = min(SHINGLE_WORDS, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += words[k : k + n] * _FACTORS[k]
    return np.unique(_mix(total))


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of shingles reach the similarity; two empty ones do."""
    if OVER * max(len(x), len(y)) > UNDER * min(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return UNDER * both >= OVER * (len(x) + len(y) - both)


def lead_size(n: int) -> int:
    """How many shingles of n lead: any two sets that are alike have one of them in common."""
    return n - -(-OVER * n // UNDER) + 1 if n else 0


def leading(found: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    """The shingles of a sorted set that lead it; crowded is a packed bitmap over their last bits."""
    place = (found & np.uint64(8 * len(crowded) - 1)).astype(np.int64)
    last = (crowded[place >> 3] >> (place & 7).astype(np.uint8)) & 1
    return found[np.argsort(last, kind="stable")][: lead_size(len(found))]


def parities(found: np.ndarray) -> bytes:
    """A bit for each of 2 ** k buckets of hashes, at least as many as there are shingles: whether their number is odd."""
    size = max(64 * FOLDS, 1 << max(0, len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(odd: bytes) -> np.ndarray:
    """Parities in 64 * FOLDS buckets."""
    return np.bitwise_xor.reduce(np.frombuffer(odd, np.int64).reshape(-1, FOLDS), axis=0)


def may_be_alike(x: bytes, y: bytes, n: int) -> bool:
    """False only if sets with these parities, of n shingles together, differ in too many: a differing bit is a differing shingle."""
    if len(x) < len(y):
        x, y = y, x
    a, size = int.from_bytes(x, "little"), 8 * len(x)
    while size > 8 * len(y):
        size //= 2
        a = (a >> size) ^ (a & ((1 << size) - 1))
    return (UNDER + OVER) * (a ^ int.from_bytes(y, "little")).bit_count() <= (UNDER - OVER) * n


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        parts = [x[: int(WIDER * lead_size(len(x)))] for x in map(shingles, batch.column(0).to_pylist())]
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])


def crowded_shingles(docs: DataFrame) -> np.ndarray:
    """The packed bitmap of shingles that, by hash alone, lead more than CROWD rows or nearly so; all rows count.

    Nothing but the bitmap, of BITMAP_BITS bits, reaches the driver.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    often = texts.mapInArrow(_first, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > CROWD)
    bits = np.zeros(BITMAP_BITS >> 3, np.uint8)
    for r in bitmap(often.select((F.pmod("h", F.lit(BITMAP_BITS)) + 1).alias("at"))).collect():
        part = np.frombuffer(r["bits"], np.uint8)  # bucket and position count from 1 and 0
        bits[(r["bucket"] - 1) * len(part) :][: len(part)] = part
    return bits


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), node (of the set of shingles), n, fp (SimHash), odd and fold (parities), lead for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(crowded_shingles(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(2).to_pylist()
            sets = [shingles(t) for t in texts]
            fps = pa.array(np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64))
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            lead = pa.array([leading(s, shared.value).view(np.int64) for s in sets], pa.list_(pa.int64()))
            n, odd = pa.array([len(s) for s in sets], pa.int64()), [parities(s) for s in sets]
            fold = pa.array([folded(x) for x in odd], pa.list_(pa.int64()))
            columns = [batch.column(0), batch.column(1), pa.array(nodes), n, fps, pa.array(odd, pa.binary()), fold, lead]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "node", "n", "fp", "odd", "fold", "lead"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hex_sha256(text).alias("digest"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest string, node long, n long, fp long, odd binary, fold array<long>, lead array<long>")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        a, b, x, y = (c.to_pylist() for c in batch.columns)
        last: tuple[str | None, np.ndarray] = None, shingles(None)
        good = []
        for s, t in zip(x, y, strict=True):
            if s != last[0]:
                last = s, shingles(s)
            good.append(alike(last[1], shingles(t)))
        kept = np.flatnonzero(good)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[kept]), pa.array(np.array(b, np.int64)[kept])], names=["a", "b"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        kept = pa.array([may_be_alike(x, y, n) for x, y, n in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)], pa.bool_())
        yield batch.select([0, 1]).filter(kept)


def verified(pairs: DataFrame, docs: DataFrame, marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b: nodes) whose sets are alike, stored. nodes: node, n, odd of each different set."""
    part = lambda k, n, odd: nodes.select(F.col("node").alias(k), F.col("n").alias(n), F.col("odd").alias(odd))
    fits = OVER * F.greatest("na", "nb") <= UNDER * F.least("na", "nb")
    both = pairs.join(part("b", "nb", "y"), "b").join(part("a", "na", "x"), "a").filter(fits)
    possible = stored(both.select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("n")).mapInArrow(_possible, "a long, b long"))
    wanted = possible.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    row = F.min(F.struct("doc_id", "digest")).alias("row")
    one = stored(marked.join(wanted, "node").groupBy("node").agg(row).select("node", "row", F.xxhash64("row").alias("mark")))
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), hex_sha256(text).alias("digest")).alias("row"), text.alias("text"))
    rows = marked_by(rows.withColumn("mark", F.xxhash64("row")), one).filter("there")
    texts = stored(rows.join(one.drop("mark"), "row").select("node", "text").dropDuplicates(["node"]))
    side = lambda k, t: texts.select(F.col("node").alias(k), F.col("text").alias(t))
    return stored(possible.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long"))


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: nodes that share a fingerprint with its first node, and first nodes of fingerprints that SimHash links."""
    fps = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(fps, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    first = lambda k: fps.select(F.col("fp").alias(k), F.col("first").alias(f"_{k}"))
    near = simhash.link_fingerprints(fps).join(first("a"), "a").join(first("b"), "b")
    return same.unionByName(near.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))).distinct()


def _placed(x: tuple[str, str], y: tuple[str, str]) -> Column:
    """Whether sets (columns of n and of the place of a shingle) can be alike if that shingle is the first they share: all before it differ."""
    both = F.least(F.col(x[0]) - F.col(x[1]), F.col(y[0]) - F.col(y[1]))
    return (UNDER + OVER) * both >= OVER * (F.col(x[0]) + F.col(y[0]))


def _stars(members: DataFrame, salt: int) -> DataFrame:
    """a, b: each member of a group (h, node, root, n, at) with those of PIVOTS members that have another root.

    Half of the pivots are any; of the others each is, in its lot of the group, the one with the least share
    of shingles before h. That has little of its own, so it is the likeliest to be alike to many.
    """
    # a node that is least after its bits are flipped; nodes are hashes, so each flip picks another one
    flips = [int(x) for x in _mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) + np.uint64(salt * PIVOTS)).view(np.int64)]
    lots = PIVOTS // 2
    lot = F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(lots))
    plain = F.min(F.struct(F.col("at") / F.col("n"), "node"))
    picks = [F.min(F.col("node").bitwiseXOR(F.lit(x))).alias(f"p{k}") for k, x in enumerate(flips[lots:])]
    found = members.withColumn("lot", lot).groupBy("h", "lot").agg(plain["node"].alias("central"), *picks)
    found = found.groupBy("h").agg(F.collect_set("central").alias("central"), *[F.min(f"p{k}").alias(f"p{k}") for k in range(PIVOTS - lots)])
    any_ = F.array(*[F.col(f"p{k}").bitwiseXOR(F.lit(x)) for k, x in enumerate(flips[lots:])])
    pivots = found.select("h", F.explode(F.array_union("central", any_)).alias("node"))
    pivots = pivots.join(members, ["h", "node"]).select("h", F.col("node").alias("pivot"), F.col("root").alias("other"), F.col("n").alias("m"), F.col("at").alias("there"))
    pairs = members.join(pivots, "h").filter((F.col("node") != F.col("pivot")) & (F.col("root") != F.col("other")) & _placed(("n", "at"), ("m", "there")))
    return pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _open(shared: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """shared and root, of the groups of shared that have at least so many members and more than one root."""
    roots = components(found).select(F.col("u").alias("node"), F.col("v").alias("root"))
    rooted = stored(shared.join(roots, "node", "left").select(*shared.columns, F.coalesce("root", "node").alias("root")))
    groups = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
    return stored(rooted.join(groups.filter((F.col("lo") < F.col("hi")) & (F.col("n") >= least)).select("h"), "h"))


def _rest(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: all pairs of members with different roots that size, places and folded parities allow."""
    before = Window.partitionBy("node").orderBy("at")
    earlier = F.array_compact(F.array(*[F.lag("h", k).over(before) for k in range(1, EARLIER + 1)]))
    folds = nodes.select("node", *[F.col("fold")[k].alias(f"f{k}") for k in range(FOLDS)])
    members = stored(members.join(folds, "node").withColumn("earlier", earlier))
    s, t = (members.select(*[F.col(c).alias(f"{x}_{c}") for c in members.columns]) for x in "st")
    differ = sum((F.bit_count(F.col(f"s_f{k}").bitwiseXOR(F.col(f"t_f{k}"))) for k in range(FOLDS)), F.lit(0))
    fits = (F.col("s_h") == F.col("t_h")) & (F.col("s_node") < F.col("t_node")) & (F.col("s_root") != F.col("t_root"))
    fits = fits & (OVER * F.greatest("s_n", "t_n") <= UNDER * F.least("s_n", "t_n")) & _placed(("s_n", "s_at"), ("t_n", "t_at"))
    fits = fits & ((UNDER + OVER) * differ <= (UNDER - OVER) * (F.col("s_n") + F.col("t_n")))
    # a pair is compared at the first shingle that both have, which no later one needs to repeat
    fits = fits & ~F.arrays_overlap("s_earlier", "t_earlier")
    return s.join(t, fits).select(F.col("s_node").alias("a"), F.col("t_node").alias("b")).distinct()


def links(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """a, b: pairs of different nodes that are alike, enough of them to connect all that are."""
    nodes = stored(marked.select("node", "n", "fp", "odd", "fold").dropDuplicates(["node"]))
    heads = marked.select("node", "n", F.posexplode("lead").alias("at", "h"))
    groups = heads.groupBy("h").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("h")
    shared = stored(heads.join(groups, "h").dropDuplicates(["h", "node"]))
    tried = stored(_fingerprint_pairs(nodes))
    found = verified(tried, docs, marked, nodes)
    members = _open(shared, found, 2)
    for k in range(ROUNDS):
        pairs = stored(_stars(members, k).join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(pairs)
        found = found.unionByName(verified(pairs, docs, marked, nodes))
        members = _open(shared, found, 3)
    rest = _rest(members, nodes).join(tried, ["a", "b"], "left_anti")
    return found.unionByName(verified(stored(rest), docs, marked, nodes))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any others) with one row of each group of near copies: that of its smallest doc_id.

    Groups are components: a text is in one with all that are alike to it. Texts without words
    are alike. A null doc_id is kept only where a group has no other; of rows that share their
    doc_id one text is kept, and of equal rows one. Columns may have any names; an empty table gives
    an empty result.
    """
    with scratch(docs.sparkSession):
        marked = stored(marks(docs))
        roots = components(links(docs, marked)).select(F.col("u").alias("node"), F.col("v").alias("root"))
        rooted = marked.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
        least = rooted.groupBy("root").agg(F.min(order).alias("least")).select("root", "least.doc_id", "least.digest")
        kept = stored(least.select("doc_id", "digest"), keep=True)
        # rows that surely stay are left where they are; the others and repeated ones are joined to those that are kept
        only = kept.withColumn("k", F.lit(0)).unionByName(marked.select("doc_id", "digest", F.lit(1).alias("k"))).groupBy(F.struct("doc_id", "digest").alias("row"))
        unsure = stored(only.agg(F.sum("k").alias("rows"), F.count("*").alias("all")).filter("rows > 1 OR all < 2").select(F.xxhash64("row").alias("mark")), keep=True)
    digest = hex_sha256(F.col("text").cast("string"))
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"))
    judged = marked_by(packed(docs, key=key).withColumn("mark", F.xxhash64("key")), unsure)
    rest = restrict(judged.filter("there").select("row", "key"), kept.select(F.struct("doc_id", "digest").alias("key")))
    return unpacked(judged.filter("NOT there").select("row").unionByName(rest.select("row")))
