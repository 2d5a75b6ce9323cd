"""Near-duplicate documents by order MinHash, verified by banded alignment.

Shingles are ``SHINGLE`` consecutive words, each labelled with its number among
equal ones of the document.  A sketch takes the ``TAKEN`` shingles of smallest
hash and keeps them in the order of the text, so it is sensitive to edits that
move text, not only to the set of shingles; ``SKETCHES`` independent sketches
make the buckets.  Two documents are linked if they share a bucket and their
words align with an edit similarity (1 - edits / longer length) of ``ALIKE`` at
least, computed on the words themselves in a band of that width.

Buckets are made in passes of ``PASS`` sketches, and each pass's shuffle files
go before the next, so their disk is that of a pass, whatever ``SKETCHES`` is.
Of the texts only those of leaders travel to a join by leader.

Exact copies are one row from the start.  Every document is first compared with
one leader, the smallest of all its buckets, then with one leader of each other
class that leads a bucket of its; so large groups are joined by one or two
alignments a document.  Then all members of a bucket that are of different
classes are compared, in blocks: buckets of one leader go together, so a pair is
looked at once for them, and lengths and bags of words rule out nearly all pairs
inside the block's task; only the others become rows and are aligned.  So the
classes are those of all pairs that share a bucket.  That last step's comparisons
grow with the square of the documents of unlike classes under one leader.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import alignment, common
from .components import components
from .hashing import U64, mix64, salted, slices, text_buffer, windows, word_hashes

SHINGLE, TAKEN, SKETCHES, ALIKE = 5, 2, 96, 0.8
#: Sketches whose buckets are made together: one pass's shuffle is on disk at a time.
PASS = 24
#: Low bits of a bucket's number, which tell the sketch.
_OF = 127
#: Rounds of leaders, members of a leader's buckets in one block, and bytes of blocks that a task compares.
STARS, BLOCK, BIN_BYTES = 3, 1024, 4 << 20
#: Pairs of a block that are looked at together, pairs of bags, and columns of a product of bags.
_PAIRS, _BAGS, _COLUMNS = 1 << 19, 1 << 13, 2048
#: Pairs of a block from which on their bags are compared by a product.
_MANY = 2000


def _shingles(hashes: np.ndarray, first: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The shingles of the rows, one after the other; a row of fewer words is one shingle."""
    count = np.diff(first)[rows]
    full = windows(hashes, size, 12)
    places = np.maximum(count - size + 1, 1)
    ends = np.cumsum(places)
    at = np.arange(ends[-1]) - np.repeat(ends - places, places) + np.repeat(first[rows], places)
    out = np.empty(len(at), U64)
    whole = np.repeat(count >= size, places)
    out[whole] = full[at[whole]]
    for n in range(1, size):
        few = rows[count == n]
        if len(few):
            out[(ends - places)[count == n]] = windows(hashes[first[few][:, None] + np.arange(n)].reshape(-1), n, 12 + n)[::n]
    return out


def sketched(hashes: np.ndarray, first: np.ndarray, size: int = SHINGLE, sketches: int = SKETCHES) -> np.ndarray:
    """The sketches of each row of word hashes (a row of zeros where there are no words)."""
    count = np.diff(first)
    out = np.zeros((len(count), sketches), U64)
    rows = np.flatnonzero(count)
    if not len(rows):
        return out
    plain = _shingles(hashes, first, rows, size)
    places = np.maximum(count[rows] - size + 1, 1)
    begins = np.cumsum(places) - places
    # label equal shingles of a document by their order in it
    own = mix64(plain ^ np.repeat(mix64(np.arange(len(rows), dtype=U64)), places))
    order = np.argsort(own, kind="stable")
    new = np.ones(len(own), dtype=bool)
    new[1:] = own[order[1:]] != own[order[:-1]]
    label = np.zeros(len(own), U64)
    run = np.flatnonzero(new)
    label[order] = (np.arange(len(own)) - np.repeat(run, np.diff(np.append(run, len(own))))).astype(U64)
    labelled = mix64(plain + label * U64(0xD1B54A32D192ED03))
    # the place of a shingle rides in the lowest bits, as many as the longest text needs
    place = (np.arange(len(own)) - np.repeat(begins, places)).astype(U64)
    low = U64((1 << max(16, int(places.max()).bit_length())) - 1)
    single = places == 1
    ranked = np.empty(len(own), U64)
    for i, odd in enumerate(salted(99, sketches) | U64(1)):
        np.multiply(labelled, odd, out=ranked)
        ranked &= ~low
        ranked |= place
        one = np.minimum.reduceat(ranked, begins)
        a = begins + (one & low).astype(np.int64)
        ranked[a] = U64(0xFFFFFFFFFFFFFFFF)
        two = np.minimum.reduceat(ranked, begins)
        b = np.where(single, a, begins + (two & low).astype(np.int64) % places)
        out[rows, i] = mix64(mix64(plain[np.minimum(a, b)]) + plain[np.maximum(a, b)]) & ~U64(_OF) | U64(i)
    return out


def _passes(sketches: int) -> list[str]:
    """The columns of sketches, ``PASS`` each."""
    return [f"sketches_{i}" for i in range(0, sketches, PASS)]


def _sketch_rows(size: int, sketches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in slices(offsets, 1 << 20):
                own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                hashes, first = word_hashes(own, at, 11)
                made = sketched(hashes, first, size, sketches)
                cuts = at.tolist()
                digest = [hashlib.blake2b(own[x:y], digest_size=16).digest() for x, y in zip(cuts, cuts[1:], strict=False)]
                passes = [np.ascontiguousarray(made[:, i : i + PASS]).view(np.int64) for i in range(0, sketches, PASS)]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1))) for x in passes]
                bag = [x.tobytes() for x in alignment.bags(hashes, first)]
                count = np.diff(first).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), batch.column("id").slice(a, b - a), pa.array(digest, pa.binary()), pa.array(count), pa.array(bag, pa.binary()), *lists], names=["key", "id", "digest", "n_words", "bag", *_passes(sketches)])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """Bags of a column as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, alignment.BINS)


def _possible(a: np.ndarray, b: np.ndarray, alike: float) -> np.ndarray:
    """Whether lengths allow a link."""
    longer = np.maximum(a, b)
    return longer - np.minimum(a, b) <= alignment.most_edits(longer, alike)


def _near_rows(alike: float):
    """The pairs whose lengths and bags allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("n_words").to_numpy(), batch.column("l_words").to_numpy()
            can = np.flatnonzero(_possible(a, b, alike))
            part = batch.take(pa.array(can))
            apart = alignment.bag_distance(_matrix(part.column("bag")), _matrix(part.column("l_bag")))
            part = part.filter(pa.array(apart <= alignment.most_edits(np.maximum(a, b)[can], alike)))
            yield part.select(["rep", "leader"])

    return run


def _aligned_rows(alike: float):
    """The pairs whose words align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, list[bytes]] = (None, [])
        for batch in batches:
            good = []
            reps, leaders = batch.column("rep").to_pylist(), batch.column("leader").to_pylist()
            for i, leader in enumerate(leaders):
                if last[0] != leader:
                    last = leader, batch.column("l_text")[i].as_py().encode().split()
                number: dict[bytes, int] = {}
                a, b = (np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in (last[1], batch.column("text")[i].as_py().encode().split()))
                most, longer = int(alignment.most_edits(np.int64(max(len(a), len(b))), alike)), max(len(a), len(b))
                shared = np.minimum(np.bincount(a, minlength=len(number)), np.bincount(b, minlength=len(number))).sum()
                good.append(longer - shared <= most and alignment.within(a, b, most))
            keep = [i for i, yes in enumerate(good) if yes]
            yield pa.RecordBatch.from_arrays([pa.array([reps[i] for i in keep], pa.int64()), pa.array([leaders[i] for i in keep], pa.int64())], names=["rep", "leader"])

    return run


def _stars(members: DataFrame, found: DataFrame | None, star: int) -> DataFrame:
    """One pair a document in the first round, later one for each other class that leads a bucket of its."""
    if not star:
        return members.where("rep != leader").groupBy("rep").agg(F.min("leader").alias("leader"))
    each = members.where("rep != leader").select("rep", "leader").distinct()
    each = _labelled(_labelled(each, found), found, "leader", "_class").where("class != _class")
    pick = F.min if star % 2 else F.max
    return each.groupBy("rep", "_class").agg(pick("leader").alias("leader")).select("rep", "leader")


def _of_leaders(frame: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of leaders alone: the others needn't travel to a join by leader."""
    return frame.join(pairs.select(F.col("leader").alias("_leader")).distinct(), F.col("rep") == F.col("_leader"), "left_semi")


def _near(pairs: DataFrame, features: DataFrame, alike: float) -> DataFrame:
    leaders = _of_leaders(features, pairs).select(F.col("rep").alias("leader"), F.col("n_words").alias("l_words"), F.col("bag").alias("l_bag"))
    joined = pairs.join(features, "rep").join(leaders, "leader").select("rep", "leader", "n_words", "l_words", "bag", "l_bag")
    return common.mapped(joined, _near_rows(alike), "rep long, leader long")


def _verified(pairs: DataFrame, texts: DataFrame, alike: float) -> DataFrame:
    leaders = _of_leaders(texts, pairs).select(F.col("rep").alias("leader"), F.col("text").alias("l_text"))
    joined = pairs.join(texts, "rep").join(leaders, "leader").select("rep", "leader", "text", "l_text")
    return common.mapped(joined, _aligned_rows(alike), "rep long, leader long")


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's words, labelled by their number among equal ones, as a sorted set of 16-bit hashes."""
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for a, b in slices(offsets, 1 << 20):
            own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            hashes, first = word_hashes(own, at, 11)
            out = []
            for x, y in zip(first.tolist(), first.tolist()[1:], strict=False):
                _, size = np.unique(hashes[x:y], return_counts=True)
                label = np.arange(y - x) - np.repeat(np.cumsum(size) - size, size)
                tokens = mix64(np.sort(hashes[x:y]) + label.astype(U64) * U64(0xD1B54A32D192ED03)) >> U64(48)
                out.append(np.unique(tokens.astype(np.uint16)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("rep").slice(a, b - a), pa.array(out, pa.binary())], names=["rep", "tokens"])


def _overlaps(tokens: list[np.ndarray], rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many tokens each of the rows shares with each of the others, by products of tables of tokens."""
    used = np.union1d(rows, others)
    which = np.repeat(np.arange(len(used)), [len(tokens[i]) for i in used.tolist()])
    values = np.concatenate([tokens[i] for i in used.tolist()])
    count = np.bincount(values, minlength=1 << 16)
    column = np.cumsum(count > 1) - 1  # a token that one text has is shared by none
    some = count[values] > 1
    which, values = which[some], column[values[some]]
    order = np.argsort(values, kind="stable")
    which, values = which[order], values[order]
    a, b = np.searchsorted(used, rows), np.searchsorted(used, others)
    out = np.zeros((len(rows), len(others)), np.float32)
    for low in range(0, int(column[-1]) + 1, _COLUMNS):
        x, y = np.searchsorted(values, [low, low + _COLUMNS])
        table = np.zeros((len(used), _COLUMNS), np.float32)
        table[which[x:y], values[x:y] - low] = 1
        out += table[a] @ table[b].T
    return out


def _crossing(alike: float):
    """Pairs of documents of different classes that share a bucket and may be links by lengths and bags; a table holds many whole blocks."""

    def run(table: pa.Table) -> pa.Table:
        leader, row, column, side, own, rep, words = (table[c].to_numpy() for c in ("leader", "row", "column", "side", "class", "rep", "n_words"))
        order = np.lexsort((own, side, column, row, leader))
        leader, row, column, side, own, rep, words = (x[order] for x in (leader, row, column, side, own, rep, words))
        masks = [table[c].to_numpy()[order] for c in ("low", "high")]
        bag = _matrix(table["bag"].combine_chunks())[order]
        raw = table["tokens"].combine_chunks().to_pylist()
        tokens = [np.frombuffer(raw[i], np.uint16) for i in order.tolist()]
        spare = words - np.array([len(t) for t in tokens])
        n = len(order)
        new = np.ones(n + 1, dtype=bool)
        new[1:n] = (leader[1:] != leader[:-1]) | (row[1:] != row[:-1]) | (column[1:] != column[:-1])
        half = new.copy()
        half[1:n] |= side[1:] != side[:-1]
        other = half.copy()
        other[1:n] |= own[1:] != own[:-1]
        block = np.cumsum(new[:n]) - 1
        after = lambda edge: np.flatnonzero(edge)[np.cumsum(edge[:n])]  # noqa: E731  where the run that holds i ends
        end, run_end, side_end = after(new), after(other), after(half)
        # within a block the members behind one's own class, across two blocks the members of the second
        start = np.where(side == 2, run_end, side_end)
        count = np.where(side == 1, 0, end - start)
        some = np.flatnonzero(count)
        total = np.concatenate([[0], np.cumsum(count[some])])
        got: list[np.ndarray] = [np.zeros((0, 2), np.int64)]

        def emit(i: np.ndarray, j: np.ndarray, overlap: np.ndarray) -> None:
            longer = np.maximum(words[i], words[j])
            near = longer - overlap - np.minimum(spare[i], spare[j]) <= alignment.most_edits(longer, alike)
            x, y = rep[i[near]], rep[j[near]]
            got.append(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1))

        at = 0
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(total, total[at] + _PAIRS, side="right")) - 1)
            part, sizes = some[at:to], count[some[at:to]]
            i = np.repeat(part, sizes)
            j = np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start[part], sizes)
            can = (own[i] != own[j]) & ((masks[0][i] & masks[0][j] | masks[1][i] & masks[1][j]) != 0) & _possible(words[i], words[j], alike)
            i, j = i[can], j[can]
            most = alignment.most_edits(np.maximum(words[i], words[j]), alike)
            near = np.zeros(len(i), dtype=bool)
            for a in range(0, len(i), _BAGS):
                near[a : a + _BAGS] = alignment.bag_distance(bag[i[a : a + _BAGS]], bag[j[a : a + _BAGS]]) <= most[a : a + _BAGS]
            i, j = i[near], j[near]
            cuts = [*np.unique(block[i], return_index=True)[1].tolist(), len(i)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                x, y = i[a:b], j[a:b]
                if b - a > _MANY:
                    rows, others = np.unique(x), np.unique(y)
                    emit(x, y, _overlaps(tokens, rows, others)[np.searchsorted(rows, x), np.searchsorted(others, y)])
                else:
                    emit(x, y, np.array([len(np.intersect1d(tokens[p], tokens[q], assume_unique=True)) for p, q in zip(x.tolist(), y.tolist(), strict=True)], np.int64))
            at = to
        pairs = np.unique(np.concatenate(got), axis=0)
        return pa.table({"rep": pairs[:, 0], "leader": pairs[:, 1]})

    return run


def _across(labelled: DataFrame, features: DataFrame, texts: DataFrame, alike: float) -> DataFrame:
    """All pairs that share a bucket, are of different classes and may be links; the documents of a leader are many blocks."""
    spark = labelled.sparkSession
    bit = F.when(F.col("i") < 64, F.expr("shiftleft(1L, i)"))
    far = F.when(F.col("i") >= 64, F.expr("shiftleft(1L, i - 64)"))
    zero = F.lit(0).cast("long")
    rows = labelled.groupBy("leader", "rep", "class").agg(F.coalesce(F.bit_or(bit), zero).alias("low"), F.coalesce(F.bit_or(far), zero).alias("high"))
    rows = common.written(rows, "led")
    mixed = rows.groupBy("leader").agg(F.count("*").alias("_n"), F.min("class").alias("_lo"), F.max("class").alias("_hi")).where("_lo < _hi")
    mixed = mixed.select(F.col("leader").alias("_leader"), F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks"))
    rows = common.again(rows).join(mixed, F.col("leader") == F.col("_leader")).drop("_leader")
    rows = common.written(rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "mixed")
    needed = rows.select(F.col("rep").alias("_rep")).distinct()
    tokens = common.mapped(texts.join(needed, F.col("rep") == F.col("_rep"), "left_semi"), _token_rows, "rep long, tokens binary")
    tokens = common.written(tokens.join(features, "rep"), "tokens")
    size = common.again(rows).join(tokens.select("rep", "n_words"), "rep").agg(F.sum(F.col("blocks") * (2 * F.col("n_words") + 250))).first()[0] or 0
    bins = common.parts(spark, size, BIN_BYTES)
    each = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    each = each.select("leader", "rep", "class", "low", "high", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("column"), side.alias("side"))
    each = each.withColumn("bin", F.pmod(F.xxhash64("leader", "row", "column"), F.lit(bins)).cast("int")).join(tokens, "rep")
    return common.grouped(each.repartition(bins, "bin"), "bin", _crossing(alike), "rep long, leader long").distinct()


def _joined(found: DataFrame | None, new: DataFrame) -> DataFrame | None:
    """Components with the new links; what is connected already is a star."""
    if not new.limit(1).count():
        return found
    edges = new.select(F.col("rep").alias("u"), F.col("leader").alias("v"))
    if found is not None:
        edges = edges.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v")))
    return components(edges)


def _labelled(frame: DataFrame, found: DataFrame | None, of: str = "rep", name: str = "class") -> DataFrame:
    """The frame with the class so far of the documents in column ``of``."""
    if found is None:
        return frame.withColumn(name, F.col(of))
    own = found.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return frame.join(own, F.col(of) == F.col("_node"), "left").withColumn(name, F.coalesce("_component", of)).drop("_node", "_component")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, sketches: int = SKETCHES, alike: float = ALIKE) -> DataFrame:
    """One row for each document: ``key``, ``id``, ``class_key``, ``class_id`` and ``n_words``.

    A class holds the documents that links connect; its id is the smallest.
    Exact copies are of one class.  Texts without words (null, empty, white
    space) are each alone.  Rows that share an id, or have none, are separate
    documents, told apart by ``key``.  A task needs about 30 bytes for each byte
    of its longest text, and at least those of a megabyte.
    """
    if not 1 <= sketches <= 128:
        raise ValueError("there are 1 to 128 sketches")
    return _classes(common.keyed(docs, id_col, text_col), size, sketches, alike)


def _classes(rows: DataFrame, size: int, sketches: int, alike: float) -> DataFrame:
    spark = rows.sparkSession
    common.small_batches(spark)
    rows = rows.select("key", "id", "text")
    passes = _passes(sketches)
    schema = "key long, id long, digest binary, n_words int, bag binary, " + ", ".join(f"{c} array<long>" for c in passes)
    made = common.written(common.mapped(rows, _sketch_rows(size, sketches), schema), "sketches")
    own = common.written(made.select("key", "id", "digest", "n_words"), "own")
    reps = common.written(own.where("n_words > 0").groupBy("digest").agg(F.min("key").alias("rep")), "reps")
    distinct = made.join(reps.select(F.col("rep").alias("_rep")), F.col("key") == F.col("_rep"), "left_semi")
    distinct = common.written(distinct.select(F.col("key").alias("rep"), "n_words", "bag", *passes), "distinct")
    common.dropped(spark, made)
    features = common.written(distinct.select("rep", "n_words", "bag"), "features")
    buckets = []
    for column in passes:
        each = distinct.select("rep", F.explode(column).alias("value"))
        shared = each.groupBy("value").agg(F.min("rep").alias("leader"), F.max("rep").alias("_hi")).where("leader < _hi")
        # the leaders are written, so that the next step knows their size
        shared = common.written(shared.select(F.col("value").alias("_value"), "leader"), "shared")
        each = each.join(shared, F.col("value") == F.col("_value"))
        buckets.append(common.written(each.select(F.col("value").bitwiseAND(F.lit(_OF)).cast("int").alias("i"), "rep", "leader"), "buckets"))
        common.dropped(spark, shared)
        del shared, each
        common.swept(spark)
    common.dropped(spark, distinct)
    members = reduce(DataFrame.unionByName, buckets)
    in_buckets = members.select(F.col("rep").alias("_rep")).distinct()
    texts = common.written(rows.select(F.col("key").alias("rep"), "text").join(in_buckets, F.col("rep") == F.col("_rep"), "left_semi"), "texts")

    tested, found = None, None
    used = [*buckets, texts, features]  # files that the result doesn't read
    for star in range(STARS + 1):
        common.swept(spark)
        if star < STARS:
            pairs = _near(_stars(members, found, star), features, alike)
        else:
            pairs = _across(_labelled(members, found), features, texts, alike)
        if tested is not None:
            pairs = pairs.join(tested, ["rep", "leader"], "left_anti")
        pairs = common.written(pairs, "pairs")
        new = common.written(_verified(pairs, texts, alike), "links")
        used += [pairs, new]
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = _joined(found, new)
    common.dropped(spark, *used)
    names = common.again(own).select(F.col("key").alias("class_key"), F.col("id").alias("class_id"))
    own = own.join(reps, "digest", "left").withColumn("rep", F.when(F.col("n_words") > 0, F.col("rep")).otherwise(F.col("key")))
    own = _labelled(own, found, "rep", "class_key")
    return own.join(names, "class_key").select("key", "id", "class_key", "class_id", "n_words")


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, sketches: int = SKETCHES, alike: float = ALIKE) -> DataFrame:
    """``docs`` with one document of each class: the one of the smallest id. Columns stay as they are."""
    rows = common.keyed(docs, id_col, text_col, whole=True)
    # the fewer keys, written: where they are small by their files, the documents need no shuffle
    gone = common.written(_classes(rows, size, sketches, alike).where("key != class_key").select("key"), "gone")
    common.swept(rows.sparkSession)
    return rows.join(gone, "key", "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document with its class of near copies."""
    found = classes(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", (F.col("key") == F.col("class_key")).alias("kept"), F.col("n_words").cast("long").alias("n_words"))
