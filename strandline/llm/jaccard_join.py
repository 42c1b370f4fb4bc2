"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word shingles. Under one global order of shingles, rare
first, two sets of sizes x and y with Jaccard similarity t share at least
o = ceil(t (x + y) / (1 + t)) shingles, and for every m the first m shared ones
are among the first x - o + m and y - o + m. Each document picks its own m: the
one with the least estimated cost, the postings its prefix scans plus the
candidates they make, which falls with m as m common shingles are asked for. Its
prefix is long enough for the smallest partner allowed. A pair is verified when
it shares the smaller of both m at places that its two sizes allow.

The order needs no exact counts: shingles that are frequent inside a run of
documents are counted, summed over all runs, and the most frequent of them (at
most ``FREQUENT``, the bound of the broadcast) sort behind all others by their
count. Equal sets are one document for the join. Groups of near copies cost
their size and not its square: a posting list first links its documents with its
most central one, which has the fewest rarer shingles. Only then are pairs sought, between documents of different components, and by
lists of one shingle and one band of sizes: a posting goes to the bands in which
its place is early enough, so documents that merely share a template do not meet.

Defined cases: a null or empty text has no shingles and links with nothing. A
text of fewer words than a shingle is one shingle. Rows without id are returned
with a null component. Rows that repeat an id are one node: it links by each of
its texts. Texts of any length are taken whole. Only doc_id and text are read, so
other columns may have any name; ``keep_one_of_each`` returns them as they are.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_most, dropped, free_name, saved
from .components import connected_components
from .textkit import runs, shingle_sets

#: Most entries of the broadcast table of frequent shingles (8 MB).
FREQUENT = 500_000
#: Rows of a side that is broadcast; beyond it the join is left to a shuffle.
BROADCAST_ROWS = 500_000
#: Shingles counted together before those seen once are left out.
COUNTED = 1 << 22
MOST_MATCHES = 8
#: Comparisons of sizes to the cost of one posting.
VERIFY_COST = 20.0
#: Places of the parities that bound from below how much two sets differ.
BITS = 2048
#: Ratio of the largest to the smallest size in a band.
BAND = 1.02


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _profile(docs: DataFrame, k: int) -> DataFrame:
    """Per document (doc_id, n, fp), and per run of documents (token, seen) of shingles seen in more than one."""
    schema = "doc_id long, n long, fp binary, token long, seen long"

    def rows(doc_id=None, n=None, fp=None, token=None, seen=None) -> pa.RecordBatch:
        size = len(doc_id if doc_id is not None else token)
        made = [(doc_id, pa.int64()), (n, pa.int64()), (fp, pa.binary()), (token, pa.int64()), (seen, pa.int64())]
        return pa.RecordBatch.from_arrays([pa.nulls(size, t) if x is None else x for x, t in made], ["doc_id", "n", "fp", "token", "seen"])

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        token, seen = np.unique(np.concatenate(held), return_counts=True)
        return rows(token=_long(token[seen > 1]), seen=pa.array(seen[seen > 1].astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in runs(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                fps = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield rows(part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()))
                held += sets
                size += sum(map(len, sets))
                if size > COUNTED:
                    yield frequent(held)
                    held, size = [], 0
        if held:
            yield frequent(held)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass
class Frequencies:
    """The most frequent shingles, sorted, their counts, and how often another one is expected elsewhere."""

    tokens: np.ndarray
    counts: np.ndarray
    elsewhere: float = 0.0


def _frequencies(profile: DataFrame) -> Frequencies:
    """At most FREQUENT shingles; what the runs show of the others is carried on to the number of runs."""
    counts = saved(profile.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")), "shingle-counts")
    least = at_most(counts, "seen", FREQUENT)
    total = profile.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rest = counts if least is None else counts.where(F.col("seen") < least)
    rare = rest.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("n")).first()["n"]
    elsewhere = min(1.0, rare / total * max(1.0, total / COUNTED)) if total else 0.0
    if least is None:
        return Frequencies(np.zeros(0, np.uint64), np.zeros(0, np.int64), elsewhere)
    got = counts.where(F.col("seen") >= least).toPandas()
    token = got["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return Frequencies(token[order], got["seen"].to_numpy(np.int64)[order], elsewhere)


def prefix(s: np.ndarray, known: Frequencies, percent: int) -> tuple[np.ndarray, int]:
    """The set's prefix, in the global order, and the number of matches it asks for."""
    n = len(s)
    slack = n - -(-percent * n // 100)  # shingles that the smallest partner may lack
    tight = n - -(-2 * percent * n // (100 + percent))  # those that a partner of the same size may lack
    most = min(MOST_MATCHES, n - slack)
    seen = np.full(n, 1 + known.elsewhere)
    if len(known.tokens):
        at = np.minimum(np.searchsorted(known.tokens, s), len(known.tokens) - 1)
        held = known.tokens[at] == s
        seen[held] = known.counts[at[held]]
        order = np.concatenate([np.flatnonzero(~held), (w := np.flatnonzero(held))[np.argsort(seen[w], kind="stable")]])
        s, seen = s[order], seen[order]
    scanned = np.cumsum(seen)[tight : tight + most]
    met = np.cumsum(seen - 1)[tight : tight + most]
    m = int(np.argmin(scanned + VERIFY_COST * met / np.arange(1, most + 1))) + 1
    return s[: slack + m], m


def _postings(docs: DataFrame, frequent: Frequencies, k: int, percent: int) -> DataFrame:
    """(token, doc, n, need, p): prefixes of all documents; p is the shingle's place in the document's order."""
    table = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            for part in runs(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                ids = part.column("doc_id").cast(pa.int64())
                made = [(i, len(s), *prefix(s, known, percent)) for i, s in zip(ids.to_pylist(), sets, strict=True) if len(s) and i is not None]
                if made:
                    sizes = [len(p) for _, _, p, _ in made]
                    yield pa.RecordBatch.from_arrays(
                        [
                            _long(np.concatenate([p for _, _, p, _ in made])),
                            pa.array(np.repeat(np.array([i for i, *_ in made], np.int64), sizes)),
                            pa.array(np.repeat(np.array([n for _, n, _, _ in made], np.int32), sizes)),
                            pa.array(np.repeat(np.array([m for *_, m in made], np.int32), sizes)),
                            pa.array(np.concatenate([np.arange(z, dtype=np.int32) for z in sizes])),
                        ],
                        ["token", "doc", "n", "need", "p"],
                    )

    return docs.select("doc_id", "text").mapInArrow(run, "token long, doc long, n int, need int, p int")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc, n, bits, s): the shingles of each text, and the parities of how many fall on each of BITS places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                sizes = np.array([len(s) for s in sets], np.int32)
                values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                place = np.repeat(np.arange(len(sets)), sizes) * BITS + (values % np.uint64(BITS)).astype(np.int64)
                parity = (np.bincount(place, minlength=len(sets) * BITS) & 1).astype(np.uint8)
                bits = np.packbits(parity, bitorder="little").view(np.int64)
                ends, words = np.append(0, np.cumsum(sizes)).astype(np.int32), np.arange(len(sets) + 1, dtype=np.int32) * (BITS // 64)
                lists = [pa.ListArray.from_arrays(pa.array(words), pa.array(bits)), pa.ListArray.from_arrays(pa.array(ends), _long(values))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), *lists], ["doc", "n", "bits", "s"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc long, n int, bits array<long>, s array<long>")


def _fits(na: Column, nb: Column, percent: int) -> Column:
    return (na * 100 >= nb * percent) & (nb * 100 >= na * percent)


def _overlap(na: Column, nb: Column, percent: int) -> Column:
    """The fewest shingles that similar sets of these sizes share."""
    return F.ceil((na + nb) * percent / (100 + percent) - 1e-9).cast("int")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The saved pairs (a, b) whose sets are similar enough, checked on whole sets of their documents.

    Sets differ in at least as many shingles as their parities differ in places, so pairs that
    differ in too many places go first. A pair then takes b's set to the place of a, so the few
    leaders' sets move once.
    """
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-documents")
    sets = saved(_sets(docs.join(_bounded(ids), "doc_id", "left_semi"), k), "sets")
    bits = [sets.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab"]
    apart = F.aggregate(F.zip_with("bitsa", "bitsb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    near = apart <= F.col("na") + F.col("nb") - 2 * _overlap(F.col("na"), F.col("nb"), percent)
    pairs = saved(pairs.join(bits[0], "a").join(bits[1], "b").where(near).select("a", "b").distinct(), "near-pairs")
    members = sets.join(_bounded(pairs), F.col("doc") == F.col("b")).select("a", "b", "s")
    heads = sets.join(_bounded(pairs.select(F.col("a").alias("doc")).distinct()), "doc", "left_semi").select(F.col("doc").alias("a"), F.col("s").alias("head"))
    common = F.size(F.array_intersect("s", "head"))
    links = saved(members.join(heads, "a").where(common * 100 >= (F.size("s") + F.size("head") - common) * percent).select("a", "b"), "links")
    dropped(sets)
    return links


def _early(a: str, b: str, percent: int) -> Column:
    """Whether a shared shingle's places in both documents are early enough for the matches that they ask for."""
    na, nb, m = F.col(f"n{a}"), F.col(f"n{b}"), F.least(f"need{a}", f"need{b}")
    o = _overlap(na, nb, percent)
    return _fits(na, nb, percent) & (F.col(f"p{a}") < na - o + m) & (F.col(f"p{b}") < nb - o + m)


def _suffixed(rows: DataFrame, mark: str, columns: tuple[str, ...], key: list[str]) -> DataFrame:
    return rows.select(*key, *[F.col(c).alias(c + mark) for c in columns])


def _led(shared: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b): each document b with the leader that most of its lists share, if they share as many shingles as asked for.

    A list's leader is the document in which its shingle comes first, so the one with the fewest rarer shingles.
    """
    columns = ("doc", "n", "need", "p")
    first = F.min(F.struct(F.col("p"), F.xxhash64("doc").alias("h"), "doc", "n", "need")).alias("l")
    leaders = saved(shared.groupBy("token").agg(first).select("token", "l.doc", "l.n", "l.need", "l.p"), "leaders")
    met = _suffixed(shared, "b", columns, ["token"]).join(_bounded(_suffixed(leaders, "a", columns, ["token"])), "token")
    met = met.where((F.col("doca") != F.col("docb")) & _early("a", "b", percent))
    counted = met.groupBy("doca", "docb").agg(F.count("*").alias("m"), F.min(F.least("needa", "needb")).alias("need")).where("m >= need")
    best = saved(counted.groupBy(F.col("docb").alias("b")).agg(F.max(F.struct("m", F.col("doca").alias("a"))).alias("x")).select("x.a", "b"), "led")
    dropped(leaders)
    return best


def _placed(shared: DataFrame, links: DataFrame) -> DataFrame:
    """shared with c, the component so far of its document."""
    hops = connected_components(links)
    placed = shared.join(hops, F.col("doc") == F.col("node"), "left").select(*shared.columns, F.coalesce("component", "doc").alias("c"))
    return saved(placed, "placed-postings")


def _across(placed: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of different components that share as many early shingles as they must.

    The larger document of a pair waits in the band of its size, the smaller one
    visits every band that may hold a partner. A pair of different components holds a
    document outside the component that is most frequent in the list, so only those
    meet the whole list.
    """
    parts = placed.groupBy("token", "c").agg(F.count("*").alias("k"))
    major = parts.groupBy("token").agg(F.max_by("c", "k").alias("major"), F.count("*").alias("cs")).where("cs > 1").drop("cs")
    lists = saved(placed.join(_bounded(saved(major, "mixed-lists")), "token"), "open-postings")
    step, n = float(np.log(BAND)), F.col("n")
    width = F.col("n") + F.col("need") - 1 - F.col("p")  # the overlap up to which this place is early enough

    def band(size: Column) -> Column:
        return F.floor(F.log(size) / step).cast("int")

    # the smaller document goes to the bands of its larger partners, farther ones need ever earlier places
    most = F.floor(n * 100 / percent + 1e-9).cast("int")
    small = lists.where(_overlap(n, n, percent) <= width).select("*", F.explode(F.sequence(band(n), band(most))).alias("band"))
    small = small.where(_overlap(n, F.greatest(n, F.floor(F.exp(F.col("band") * step) - 1e-6).cast("int")), percent) <= width)
    large = lists.withColumn("band", band(n))
    columns, key = ("doc", "n", "need", "p", "c"), ["token", "band"]
    fits = (F.col("ca") != F.col("cb")) & ((F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("doca") < F.col("docb"))) & _early("a", "b", percent)
    minor = F.col("c") != F.col("major")
    met = _suffixed(small.where(minor), "a", columns, key).join(_suffixed(large, "b", columns, key), key).where(fits)
    met = met.unionByName(_suffixed(small.where(~minor), "a", columns, key).join(_suffixed(large.where(minor), "b", columns, key), key).where(fits))
    pairs = met.groupBy(F.col("doca").alias("a"), F.col("docb").alias("b")).agg(F.count("*").alias("m"), F.min(F.least("needa", "needb")).alias("need"))
    return saved(pairs.where("m >= need").select("a", "b"), "candidates")


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n and rep of each row, links between representatives of different texts that connect all similar ones).

    rep is the smallest id with an equal set. Links (a, b) join representatives; their
    components are those of the full similarity graph.
    """
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    profile = saved(_profile(docs, k), "shingles")
    members = profile.where("token is null").select("doc_id", "n", "fp")
    reps = members.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    reps = saved(reps, "representatives")
    frequent = _frequencies(profile)
    chosen = _bounded(reps.select(F.col("rep").alias("doc")))
    postings = saved(_postings(docs, frequent, k, percent).join(chosen, "doc", "left_semi"), "postings")
    several = saved(postings.groupBy("token").count().where("count > 1").select("token"), "several")
    several = F.broadcast(several) if several.count() <= 4 * BROADCAST_ROWS else several
    shared = saved(postings.join(several, "token", "left_semi"), "shared-postings")
    dropped(postings)
    links = _verified(docs, _led(shared, percent), k, percent)
    placed = _placed(shared, links)
    more = _verified(docs, _across(placed, percent), k, percent)
    dropped(shared)
    dropped(placed)
    full = members.join(reps, "fp", "left").select("doc_id", "n", "rep")
    # rows that repeat an id with different texts tie the representatives of these texts
    several = full.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a != hi").drop("hi")
    same = saved(full.join(several, "doc_id").where("a != rep").select("a", F.col("rep").alias("b")), "same-id")
    return full, links.unionByName(more).unionByName(same)


def cluster_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of each row."""
    full, links = similar_documents(docs, k, percent)
    found = connected_components(links)
    joined = full.join(found, F.col("rep") == F.col("node"), "left")
    own = joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return own


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the smallest id of their component; rows without id stay, repeated rows of it too."""
    gone = free_name(docs, "gone")
    found = cluster_documents(docs, k, percent).where("doc_id != component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(_bounded(saved(found, "near-copies")), F.col("doc_id").cast("long") == F.col(gone), "left_anti")
