"""Documents linked by Jaccard similarity of their word n-gram sets, and their components.

The product of the document by n-gram matrix with its transpose is taken in blocks of
columns. The first block holds, for each document, the rarest n-grams that it cannot link
without: with n n-grams and similarity s, all but the last ceil(s * n) - 1 of them in the order
of frequency. Documents with an equal column there are candidates; pairs whose sizes, or whose
n-grams left after the column, cannot add up to the needed overlap are discarded. The overlap
in the whole first block bounds that of the other pairs again; what still can be similar enough
has its overlap summed over all columns.

Equal sets are one row of the matrix. In a group of documents with a common column only the
pairs with the group's most central member are tested first; the components of those links
leave few groups with members apart, and of these every pair of different components that the
bounds allow is tested. So each link between different texts is either tested or lies inside a
component that is known, and no group is expanded into all its pairs.

The order of frequency only steers how much work there is: n-grams that ``REPORT`` documents of
a batch hold are counted over all batches, and the ``ORDERED`` most frequent ones come last.

Null texts and texts without words have no n-grams and are linked with nothing; a text of
fewer words than n has its whole word sequence as its only n-gram. Equal doc_ids are one
document; a null doc_id takes part, but can't name a component unless all its members are null.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.llm import graph, shared
from dayspan.llm import textscan as ts
from dayspan.llm.decontaminate import Lookup

REPORT, ORDERED = 2, 500_000
BATCH_BYTES = 4 << 20
SLOTS = 1 << 22  # bits of the table of wanted ids


def n_gram_rows(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of a chunk and their rows."""
    low = ts.LOWER[raw]
    starts, ends, rows = ts.word_bounds(low, at, ts.SPACE)
    words = ts.span_hashes(low, starts, ends)
    grams, first = ts.shingles(words, rows, k)
    hashes, owners = [grams], [rows[first]]
    count = np.bincount(rows, minlength=len(at) - 1)
    begin = np.cumsum(count) - count
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        if len(short):
            hashes.append(ts.joined([words[begin[short] + i] for i in range(n)]))
            owners.append(short)
    return np.concatenate(hashes), np.concatenate(owners)


def row_sets(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, sorted by row and hash."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], rows[new]


def frequent(docs: DataFrame, k: int) -> np.ndarray:
    """The most frequent n-grams, rarest first; at most ``ORDERED`` of them."""

    def report(batches):
        def ended(held):
            values, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= REPORT
            return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(n[many])], names=["gram", "n"])

        held, size = [], 0
        for batch in batches:
            raw, at = ts.text_bytes(batch.column(0))
            for _, _, part, offsets in ts.chunks(raw, at):
                held.append(row_sets(*n_gram_rows(part, offsets, k))[0])
                size += len(part)
                if size > BATCH_BYTES:
                    yield ended(held)
                    held, size = [], 0
        if held:
            yield ended(held)

    found = docs.select("text").mapInArrow(shared.giving_back(report), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    table = found.orderBy(F.desc("n"), "gram").limit(ORDERED).toArrow()  # bounded
    return np.asarray(table["gram"].combine_chunks() if table.num_rows else pa.array([], pa.int64())).view(np.uint64)[::-1].copy()


def document_sets(docs: DataFrame, k: int, percent: int, order: np.ndarray) -> DataFrame:
    """(doc_id, n, d1, d2, prefix): size and digest of the set, and the n-grams of the first block."""
    given = docs.sparkSession.sparkContext.broadcast(order)  # at most ORDERED numbers

    def make(batches):
        grams = given.value
        look = Lookup(grams)
        place_of = np.empty(len(grams), np.int64)
        place_of[np.searchsorted(look.sorted, grams)] = np.arange(1, len(grams) + 1)
        for batch in batches:
            raw, at = ts.text_bytes(batch.column(1))
            for low, high, part, offsets in ts.chunks(raw, at):
                h, rows = row_sets(*n_gram_rows(part, offsets, k))
                n = np.bincount(rows, minlength=high - low)
                d = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ts.mix(h ^ np.uint64(salt)))])
                    end = np.cumsum(n)
                    d.append((total[end] - total[end - n]).view(np.int64))
                rank = np.zeros(len(h), np.int64)
                at_, which = look.find(h)
                rank[at_] = place_of[which]
                sort = np.lexsort((rank, rows))
                h, rows = h[sort], rows[sort]
                length = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                inside = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) < length[rows]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(h[inside].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(n), pa.array(d[0]), pa.array(d[1]), lists], names=["doc_id", "n", "d1", "d2", "prefix"])

    return docs.mapInArrow(shared.giving_back(make), "doc_id long, n long, d1 long, d2 long, prefix array<long>")


def full_sets(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """(doc_id, grams): sorted n-grams of the documents (doc_id) that are wanted, and a few others.

    Ids are looked up in a bit table of fixed size, so no text is shuffled; what else has the
    bit of a wanted id falls out of the later joins.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    seen = np.zeros(SLOTS, bool)
    table = wanted.select(slot.cast("int").alias("slot")).distinct().toArrow()  # at most SLOTS numbers
    seen[table["slot"].to_numpy()] = True
    given = docs.sparkSession.sparkContext.broadcast(np.packbits(seen))

    def make(batches):
        bits = np.unpackbits(given.value).view(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column(2).to_numpy()]))
            raw, at = ts.text_bytes(batch.column(1))
            for low, high, part, offsets in ts.chunks(raw, at):
                h, rows = row_sets(*n_gram_rows(part, offsets, k))
                end = 8 * np.cumsum(np.bincount(rows, minlength=high - low))
                data = h.tobytes()
                cells = [data[a:b] for a, b in zip([0, *end[:-1].tolist()], end.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(cells, pa.binary())], names=["doc_id", "grams"])

    return docs.filter("doc_id is not null").select("doc_id", "text", slot.cast("int").alias("slot")).mapInArrow(shared.giving_back(make), "doc_id long, grams binary")


def joined_pairs(pairs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Pairs (a, b) with the columns of ``rows`` for both, prefixed by a_ and b_."""
    for side in "ab":
        named = rows.select(*[F.col(c).alias(side if c == key else f"{side}_{c}") for c in rows.columns])
        pairs = pairs.join(named, side)
    return pairs


def possible(pairs: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the overlap in the first block does not rule out.

    Of two prefixes one ends first in the common order; past its end and past the last common
    n-gram of the other one lie all n-grams that may still be common.
    """
    sides = F.sort_array(F.collect_list(F.struct("gram", "place")))
    rows = entries.groupBy("node", "n", "tag").agg(sides.alias("s")).select("node", "n", F.col("s.gram").alias("grams"), F.col("s.place").alias("places"))

    def bounded(batches):
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            n = [batch.column(at[f"{c}_n"]).to_numpy() for c in "ab"]
            first = [x - (percent * x + 99) // 100 + 1 for x in n]
            edges = [batch.column(at[f"{c}_grams"]).offsets.to_numpy() for c in "ab"]
            grams = [batch.column(at[f"{c}_grams"]).values.to_numpy() for c in "ab"]
            places = [batch.column(at[f"{c}_places"]).values.to_numpy() for c in "ab"]
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                low, high = [e[i] for e in edges], [e[i + 1] for e in edges]
                x, y = grams[0][low[0]:high[0]], grams[1][low[1]:high[1]]
                where = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = np.flatnonzero(y[where] == x)
                if not len(both):
                    continue
                last = places[0][low[0] + both].max(), places[1][low[1] + where[both]].max()
                rest = [m[i] - 1 - p for m, p in zip(n, last)]
                most = len(both) + max(min(n[0][i] - first[0][i], rest[1]), min(rest[0], n[1][i] - first[1][i]))
                keep[i] = most * (100 + percent) >= percent * (n[0][i] + n[1][i])
            yield batch.filter(pa.array(keep)).select([at["a"], at["b"]])

    return joined_pairs(pairs, rows, "node").mapInArrow(shared.giving_back(bounded), "a long, b long").distinct()


def tested(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by their overlap in all columns."""
    pairs = shared.stored(pairs, "possible-pairs")
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    sets = shared.stored(full_sets(docs, k, wanted), "whole-sets")

    def overlap(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                place = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                both = int((y[place] == x).sum()) if len(y) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and len(y) > 0)
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return joined_pairs(pairs, sets, "doc_id").select("a", "b", "a_grams", "b_grams").mapInArrow(shared.giving_back(overlap), "a long, b long").distinct()


def linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, component) of documents (doc_id, text): one row per input row."""
    docs = shared.text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = shared.stored(document_sets(docs, k, percent, frequent(docs, k)), "ngram-sets")
    equal = ["d1", "d2", "n"]
    classes = made.filter("n > 0").groupBy(*equal).agg(F.min("doc_id").alias("node"), F.min_by("prefix", "doc_id").alias("prefix"))
    entries = classes.filter("node is not null").select("node", "n", F.pmod("d1", F.lit(1 << 16)).cast("int").alias("tag"), F.posexplode("prefix").alias("place", "gram"))
    common = entries.groupBy("gram").agg(F.count("*").alias("members")).filter("members > 1").select("gram")
    # an n-gram can be the first common one of a pair only if the other size is within reach
    need = percent / (100.0 + percent)
    reach = F.floor((F.col("n") - F.col("place")) / need - F.col("n") + 1e-6)
    entries = shared.stored(entries.join(common, "gram").withColumn("reach", reach), "common-ngrams")
    # a member is central if few of its rare n-grams are its own
    own = entries.groupBy("node", "n", "tag").agg((F.max("place") + 1 - F.count("*")).alias("own"))
    hubs = entries.join(own, ["node", "n", "tag"]).groupBy("gram").agg(F.min(F.struct("own", "node", "n", "reach")).alias("hub"))
    pairs = entries.join(hubs, "gram").filter("node <> hub.node and hub.n <= reach and n <= hub.reach")
    pairs = pairs.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
    first = shared.stored(tested(possible(pairs, entries, percent), docs, k, percent), "first-links")
    # what is left: groups whose members lie in different components, within the bounds
    known = graph.components(first).select(F.col("node").alias("k_node"), F.col("component").alias("part"))
    placed = entries.join(known, F.col("node") == F.col("k_node"), "left").select("gram", "node", "n", "reach", F.coalesce("part", "node").alias("part"))
    placed = shared.stored(placed, "placed-ngrams")
    smallest = placed.groupBy("gram").agg(F.min("n").alias("least"))
    able = placed.join(smallest, "gram").filter("reach >= least").drop("least")
    mixed = able.groupBy("gram").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("gram")
    able = able.join(mixed, "gram")
    x, y = (able.select("gram", *[F.col(c).alias(f"{p}_{c}") for c in ("node", "n", "part", "reach")]) for p in "xy")
    open_pairs = x.join(y, "gram").filter("x_part < y_part and y_n <= x_reach and x_n <= y_reach").select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()
    more = tested(possible(open_pairs, entries, percent), docs, k, percent)
    nodes = graph.components(shared.stored(first.union(more), "all-links"))
    keys = classes.select(*[F.col(c).alias(f"c_{c}") for c in equal], F.col("node").alias("c_node"))
    same = F.col("d1").eqNullSafe(F.col("c_d1")) & (F.col("d2") == F.col("c_d2")) & (F.col("made_n") == F.col("c_n"))
    rows = made.select("doc_id", "d1", "d2", F.col("n").alias("made_n")).join(keys, same, "left")
    rows = rows.join(nodes, F.col("c_node") == F.col("node"), "left")
    return rows.select("doc_id", F.col("made_n").alias("n"), F.coalesce("component", "c_node", "doc_id").alias("component"))
