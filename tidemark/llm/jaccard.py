"""Exact n-gram Jaccard join with set-relation skipping.

1. A count sketch of fixed size over all shingles orders tokens from rare to frequent. The order
   only has to be the same everywhere, so the sketch costs no exactness, and a passage shared by
   many documents falls out of nearly all prefixes.
2. Documents with equal sets form a class; the smallest doc_id stands for it (a set's answers
   are those of its equal).
3. The prefixes of the representatives make inverted lists. Entries are ordered by set size;
   blocks of entries carry their ranges of size, position and component, and block pairs that the
   length and position bounds rule out are skipped as a whole.
4. First each set is compared with its likeliest partner, by parity bitmaps. Then candidates are tried
   in windows of list distance: 1-3, 4-63, 64-1023 and so on. Between these steps the links found so far are joined to components, and a pair inside one component is skipped: its
   answer follows. A pair whose overlaps with a common third set are known is decided from them
   where the bounds allow (derived answers); only the others are verified on the sets.
   Every pair of every list is reached by some window, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_SCHEMA, reduce_blocks, row
from .common import bound_batches, materialise
from .components import connected_components
from .textkernel import mix64, shingle_hashes, slices, texts_words

SKETCH_BITS = 22
BLOCK_BITS = 16
BITMAP_BITS = 23
LIST_BLOCK = 64
PARITY_BITS = 512
#: Sketch level of tokens with 1,024 occurrences or more.
HOT_LEVEL = 143
SMALL_ROWS = 200_000
SLICE = 1 << 20
WINDOWS_FROM = 4
WINDOW_GROWTH = 16


def _raw_shingles(column: pa.Array, size: int):
    words, first = texts_words(column)
    return shingle_hashes(words, first, size)


def _sets(column: pa.Array, size: int, levels: np.ndarray):
    """Sorted distinct tokens of all texts, each text's start (one more entry at the end).

    A token is the sketch level of a shingle in 8 bits above 56 bits of its hash: sorted tokens run from rare to frequent.
    """
    h, owner = _raw_shingles(column, size)
    bucket = (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    token = (levels[bucket].astype(np.uint64) << np.uint64(56)) | (h & np.uint64((1 << 56) - 1))
    n = len(column)
    ends = np.cumsum(np.bincount(owner, minlength=n)) if len(owner) else np.zeros(n, np.int64)
    at = 0
    for end in ends:
        if end - at > 1:
            token[at:end].sort()
        at = end
    keep = np.ones(len(token), dtype=bool)
    keep[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[keep], owner[keep]
    return token, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int64), owner


def shingle_levels(docs: DataFrame, size: int) -> np.ndarray:
    """A frequency level (one byte) for each of 2**22 hash buckets, from the counts of all documents' shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                h, _ = _raw_shingles(part.column("text"), size)
                np.add.at(counts, (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
        if counts.any():
            for block, part in enumerate(counts.reshape(-1, 1 << BLOCK_BITS)):
                yield row(block, part)

    def add(a, b, out):
        s = a.astype(np.uint64) + b
        np.minimum(s, np.uint64(0xFFFFFFFF), out=s)
        out[...] = s

    blocks = reduce_blocks(docs.select("text").mapInArrow(run, BLOCK_SCHEMA), np.uint32, add)
    counts = np.concatenate([blocks.get(b, np.zeros(1 << BLOCK_BITS, np.uint32)) for b in range(1 << (SKETCH_BITS - BLOCK_BITS))])
    large = np.minimum(255, 128 + 5 * np.log2(np.maximum(counts, 128) / 128.0)).astype(np.uint8)
    return np.where(counts < 128, counts, large).astype(np.uint8)


def _signatures(docs: DataFrame, size: int, num: int, den: int, levels) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                token, starts, owner = _sets(part.column("text"), size, levels.value)
                n = np.diff(starts)
                prefix = np.where(n > 0, n - (num * n + den - 1) // den + 1, 0)
                position = np.arange(len(token)) - starts[owner]
                head = token[position < prefix[owner]].astype("<u8").tobytes()
                cuts = np.concatenate(([0], np.cumsum(prefix))) * 8
                sums = []
                for seed in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    mixed = np.concatenate((np.cumsum(mix64(token ^ np.uint64(seed))), [np.uint64(0)])).astype(np.uint64)
                    upto = np.concatenate(([np.uint64(0)], mixed[:-1])).astype(np.uint64)
                    sums.append((upto[starts[1:]] - upto[starts[:-1]]).view(np.int64))
                blobs = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(head)]).cast(pa.binary())
                parity = np.bincount(owner * PARITY_BITS + (token & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=len(n) * PARITY_BITS) & 1
                packed = np.packbits(parity.astype(bool).reshape(len(n), PARITY_BITS), axis=1)
                parities = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PARITY_BITS // 8), len(n), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), blobs, parities], ["doc_id", "n", "f1", "f2", "prefix", "parity"])

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, prefix binary, parity binary")


def _dealt(lists: DataFrame) -> DataFrame:
    """Postings by token. A frequent token, as its level says, is dealt out by node as well: some LIST_BLOCK entries each, at any size."""
    level = F.shiftrightunsigned("token", 56)
    parts = F.pow(F.lit(2.0), F.floor((level - HOT_LEVEL) / 5)) * 16
    salt = F.when(level >= HOT_LEVEL, F.pmod(F.xxhash64("node"), parts.cast("long"))).otherwise(0)
    return lists.withColumn("salt", salt).repartition("token", "salt").sortWithinPartitions("token", "salt").drop("salt")


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "prefix", 8 << 20):
            lengths = pa.compute.binary_length(batch.column("prefix")).to_numpy(False).astype(np.int64) // 8
            token = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in batch.column("prefix")), dtype="<i8")
            begin = np.cumsum(lengths) - lengths
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(token),
                    pa.array(np.repeat(batch.column("node").to_numpy(False), lengths)),
                    pa.array(np.repeat(batch.column("n").to_numpy(False), lengths).astype(np.int32)),
                    pa.array((np.arange(len(token)) - np.repeat(begin, lengths)).astype(np.int32)),
                ],
                ["token", "node", "n", "pos"],
            )


def _may_link(na, nb, pa_, pb, num, den):
    """The length and position bounds for a common token at these positions."""
    least = np.minimum(pa_, pb) + np.minimum(na - pa_, nb - pb)
    return (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & ((num + den) * least >= num * (na + nb))


def _parities(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("parity").to_pylist()), dtype="<u8").reshape(batch.num_rows, -1)


def _differ_too_much(a, b, na, nb, num, den):
    """A bit where the parities of two sets differ stands for at least one token that only one of them has."""
    apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return (num + den) * apart > (den - num) * (na + nb)


def _prune_lists(num: int, den: int, guess: bool = False, stretch: int = 4096):
    """Of postings sorted by token, those that have a partner in their list which the bounds admit.

    Lists of over LIST_BLOCK entries and those of frequent tokens, which come in parts, pass as they are, and
    only ``stretch`` entries of a list are held at once. With ``guess`` the bounds include the parity bitmaps, and each entry gets the partner
    whose bitmap differs least: a guess at what will link; what it misses is left to the windows.
    """

    def chosen(batch: pa.RecordBatch, long) -> pa.RecordBatch:
        token, node, n, pos = (batch.column(x).to_numpy(False).astype(np.int64) for x in ("token", "node", "n", "pos"))
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        sizes = np.diff(np.append(first, len(token)))
        size = np.repeat(sizes, sizes)
        left = size - (np.arange(len(token)) - np.repeat(first, sizes))
        keep = (size > LIST_BLOCK) | (token.view(np.uint64) >> np.uint64(56) >= HOT_LEVEL)
        if long is not None:
            keep |= token == long
        rows = np.flatnonzero(left > 1) if guess else np.flatnonzero((left > 1) & ~keep)
        parity = _parities(batch) if guess else None
        best, least = np.full(len(token), -1), np.full(len(token), 1 << 30)
        d = 1
        while len(rows):
            i, j = rows, rows + d
            ok = _may_link(n[i], n[j], pos[i], pos[j], num, den) & (node[i] != node[j])
            i, j = i[ok], j[ok]
            if guess:
                apart = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64)
                ok = (num + den) * apart <= (den - num) * (n[i] + n[j])
                i, j, apart = i[ok], j[ok], apart[ok]
                for x, y in ((i, j), (j, i)):
                    better = apart < least[x]
                    least[x[better]], best[x[better]] = apart[better], y[better]
            keep[i] = keep[j] = True
            d += 1
            rows = rows[left[rows] > d]
        if guess:
            partner = pa.array(node[np.maximum(best, 0)], mask=best < 0)
            batch = pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("token", "node", "n", "pos")), partner, pa.array(least)], ["token", "node", "n", "pos", "partner", "apart"])
        return batch.filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            token = batch.column("token").to_numpy(False)
            last = len(token) - int(np.searchsorted(token[::-1] != token[-1], True))
            if last:
                yield chosen(batch.slice(0, last), long)
                long = None
            held = batch.slice(last)
            if held.num_rows > stretch:
                long = token[-1]
                yield chosen(held, long)
                held = None
        if held is not None:
            yield chosen(held, long)

    return run


def _window_pairs(lo: int, hi: int, num: int, den: int):
    """Pairs at list distance lo <= d < hi, of rows sorted by (token, n, node)."""
    names = ["token", "node", "n", "pos", "comp", "pivot", "pov", "pn"]

    def emit(c, i, j):
        t, node, n, pos, comp, pivot, pov, pn, parity = c
        ok = (t[i] == t[j]) & (comp[i] != comp[j]) & _may_link(n[i], n[j], pos[i], pos[j], num, den)
        i, j = i[ok], j[ok]
        ok = ~_differ_too_much(parity[i], parity[j], n[i], n[j], num, den)
        i, j = i[ok], j[ok]
        same = pivot[i] == pivot[j]
        least = np.maximum(0, pov[i] + pov[j] - pn[i])
        most = np.minimum(pov[i], pov[j]) + np.minimum(n[i] - pov[i], n[j] - pov[j])
        total = num * (n[i] + n[j])
        known = same & ((num + den) * least >= total)
        ok = ~same | ((num + den) * most >= total)
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        return a[ok], b[ok], known[ok]

    def blocks(c, new):
        """Block pairs that bounds on size, position and component can't rule out, then their rows."""
        t, node, n, pos, comp = c[:5]
        size = len(t)
        cut = np.arange(0, size, LIST_BLOCK)
        low, high = (lambda x: np.minimum.reduceat(x, cut)), (lambda x: np.maximum.reduceat(x, cut))
        t0, t1, n0, n1, r1, c0, c1, p1 = low(t), high(t), low(n), high(n), high(n - pos), low(comp), high(comp), high(pos)
        for j in range(new // LIST_BLOCK, len(cut)):
            i = np.arange(max(0, j - hi // LIST_BLOCK - 1), j + 1)
            i = i[
                (t1[i] >= t0[j]) & (t0[i] <= t1[j]) & ((t0[i] != t1[i]) | (den * n1[i] >= num * n0[j]) | (t0[j] != t1[j]))
                & ((c0[i] != c1[i]) | (c0[j] != c1[j]) | (c0[i] != c0[j]))
                & ((num + den) * (np.minimum(p1[i], p1[j]) + np.minimum(r1[i], r1[j])) >= num * (n0[i] + n0[j]))
            ]
            for k in i:
                x, y = np.meshgrid(np.arange(cut[k], min(size, cut[k] + LIST_BLOCK)), np.arange(cut[j], min(size, cut[j] + LIST_BLOCK)), indexing="ij")
                d = (y - x).ravel()
                ok = (d >= lo) & (d < hi) & (y.ravel() >= new)
                if ok.any():
                    yield x.ravel()[ok], y.ravel()[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [*(batch.column(x).to_numpy(False).astype(np.int64) for x in names), _parities(batch)]
            new = 0
            if held is not None:
                new = len(held[0])
                c = [np.concatenate(x) for x in zip(held, c, strict=True)]
            size = len(c[0])
            if hi <= LIST_BLOCK:
                found = ((np.arange(max(0, new - d), size - d), np.arange(max(0, new - d) + d, size)) for d in range(lo, min(hi, size)))
            else:
                found = blocks(c, new)
            for i, j in found:
                a, b, known = emit(c, i, j)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(known)], ["a", "b", "known"])
            held = [x[-hi:] for x in c]

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, own = None, []
        for batch in batches:
            out = []
            for h, m, blob in zip(batch.column("home").to_pylist(), batch.column("member").to_pylist(), batch.column("tokens")):
                mine = np.frombuffer(blob.as_buffer(), dtype="<u8")
                if h != home:
                    home, own = h, []
                if m == h:
                    own.append(mine)
                    continue
                for x in own:
                    both = len(np.intersect1d(x, mine, assume_unique=True))
                    out.append((h, m, both, len(x), len(mine), (num + den) * both >= num * (len(x) + len(mine))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["a", "b", "both", "na", "nb", "linked"])

    return run


def _node_bitmap(nodes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over hashes of the nodes; at any fill it only lets more rows through."""

    def bits(values: np.ndarray) -> np.ndarray:
        return (mix64(values.astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITMAP_BITS, dtype=bool)
        for batch in batches:
            seen[bits(batch.column(0).to_numpy(False))] = True
        if seen.any():
            yield row(0, np.packbits(seen))

    found = reduce_blocks(nodes.mapInArrow(run, BLOCK_SCHEMA), np.uint8, np.bitwise_or)
    return np.unpackbits(found[0]).astype(bool) if found else np.zeros(1 << BITMAP_BITS, dtype=bool)


def _node_sets(docs: DataFrame, size: int, levels, bitmap) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            hashed = mix64(ids.fill_null(0).to_numpy(False).astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITMAP_BITS)
            keep = bitmap.value[hashed.astype(np.int64)] & ids.is_valid().to_numpy(False)
            for part in slices(batch.filter(pa.array(keep)), limit=SLICE):
                token, starts, _ = _sets(part.column("text"), size, levels.value)
                data = token.astype("<u8").tobytes()
                blobs = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(starts * 8), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), blobs], ["doc", "tokens"])

    return docs.mapInArrow(run, "doc long, tokens binary")


def jaccard_components(docs: DataFrame, *, shingle: int = 4, percent: int = 85) -> DataFrame:
    """Components of the graph that links documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    ``docs`` needs doc_id (long) and text. Returns one row per input row: doc_id, n_shingles,
    component_id. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer words than a
    shingle is one shingle as a whole.

    Null or blank text: no shingles, no links, its own component. Null doc_id: counted, linked with
    nothing, component null. Repeated doc_id: each row is compared on its own. Equal texts: one class. Other columns are ignored.
    Texts of any length are one set. Empty table: no rows. Sets are compared by 56-bit shingle hashes, set equality by 128 bits.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bound_batches(spark)
    num, den = percent, 100
    levels = spark.sparkContext.broadcast(shingle_levels(docs, shingle))
    signatures = materialise(_signatures(docs, shingle, num, den, levels).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    classes = materialise(
        signatures.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("node"), F.min_by("rid", "doc_id").alias("rid"), F.count("*").alias("copies")), "classes"
    )
    # One row of each class, however often a row of the table is repeated.
    chosen = signatures.drop("doc_id").join(classes.select("node", F.col("rid").alias("crid")), F.col("rid") == F.col("crid"))
    plain = "token long, node long, n int, pos int"
    postings = chosen.select("node", "n", "prefix").mapInArrow(_explode, plain)
    lists = materialise(_dealt(postings).mapInArrow(_prune_lists(num, den), plain), "lists")
    parities = chosen.select(F.col("node").alias("pnode"), F.col("n").alias("pn"), "parity")
    lists = lists.join(parities, (F.col("node") == F.col("pnode")) & (F.col("n") == F.col("pn"))).select("token", "node", "n", "pos", "parity")
    guessed = _dealt(lists).mapInArrow(_prune_lists(num, den, guess=True), f"{plain}, partner long, apart long")
    lists = materialise(guessed, "pruned-lists")
    labels = None
    if not lists.isEmpty():
        labels = _link_lists(docs, lists, parities, shingle, num, den, levels)
    named = classes if labels is None else classes.join(labels, "node", "left").withColumn("node", F.coalesce("label", "node"))
    named = materialise(named.where("copies > 1 OR node IS NOT NULL").select(F.col("n").alias("cn"), F.col("f1").alias("c1"), F.col("f2").alias("c2"), "node", "copies"), "named")
    # A class with over a thousandth of all rows is one of at most a thousand: those are broadcast, so no key is hot in the other join.
    large = max(1, signatures.count() // 1000)
    hot = F.broadcast(named.where(F.col("copies") > large).select(*[F.col(c).alias(f"h{c}") for c in ("cn", "c1", "c2", "node")]))
    rows = signatures.select("doc_id", "n", "f1", "f2").join(hot, (F.col("n") == F.col("hcn")) & (F.col("f1") == F.col("hc1")) & (F.col("f2") == F.col("hc2")), "left")
    cold = named.where(F.col("copies") <= large).drop("copies")
    done = rows.where("hnode IS NOT NULL").select("doc_id", "n", F.col("hnode").alias("node"))
    rest = rows.where("hnode IS NULL").join(cold, (F.col("n") == F.col("cn")) & (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")), "left").select("doc_id", "n", "node")
    return done.unionByName(rest).select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id names its component: one document of each group, all columns as they are, whatever their names.

    Null or empty texts are linked with nothing and stay, as do rows with a null doc_id. Of equal texts the smallest
    doc_id stays. Rows that repeat a doc_id stay or go together. Empty table: no rows.
    """
    found = jaccard_components(docs, **options)
    apart = F.min((F.col("doc_id") != F.col("component_id")).cast("int"))
    dropped = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("gone")).agg(apart.alias("far")).where("far = 1").select("gone")
    return docs.join(dropped, docs["doc_id"] == dropped["gone"], "left_anti")


def _checked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The overlap of each pair (a, b): the sets go to the pair's first node, its own once.

    Up to SMALL_ROWS requests go to the sets by broadcast (16 bytes each), more by a shuffle of both.
    """
    asked = pairs.select(F.col("a").alias("home"), F.col("b").alias("member"))
    asked = asked.unionByName(asked.select("home", F.col("home").alias("member")).distinct())
    if 2 * pairs.count() <= SMALL_ROWS:
        asked = F.broadcast(asked)
    found = (
        sets.join(asked, F.col("member") == F.col("doc")).select("home", "member", "tokens", (F.col("member") != F.col("home")).alias("other"))
        .repartition("home").sortWithinPartitions("home", "other")
        .mapInArrow(_verify(num, den), "a long, b long, both long, na long, nb long, linked boolean")
    )
    return materialise(found, "verified")


def _link_lists(docs: DataFrame, lists: DataFrame, parities: DataFrame, shingle: int, num: int, den: int, levels) -> DataFrame:
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(_node_bitmap(lists.select("node")))
    parities = materialise(parities.join(lists.select(F.col("node").alias("need")).distinct(), F.col("pnode") == F.col("need"), "left_semi"), "parities")
    sets = materialise(_node_sets(docs, shingle, levels, bitmap), "sets")
    # First each node's likeliest partner: most groups hang together by these links alone.
    best = lists.where("partner IS NOT NULL").groupBy("node").agg(F.min(F.struct("apart", "partner")).alias("s"))
    pairs = materialise(best.select(F.least("node", "s.partner").alias("a"), F.greatest("node", "s.partner").alias("b")).distinct(), "pairs")
    checked = _checked(pairs, sets, num, den)
    links = checked.where("linked").select("a", "b")
    current = lists.select("token", "node", "n", "pos")
    lo, hi = 1, WINDOWS_FROM
    while True:
        # Only lists with more than one component left, and entries further apart than tried, stay open.
        labels = connected_components(links)
        named = labels.select(F.col("node").alias("w"), "label")
        current = materialise(current.join(named, F.col("node") == F.col("w"), "left").select("token", "node", "n", "pos", F.coalesce("label", "node").alias("comp")), "lists")
        open_ = current.groupBy(F.col("token").alias("ot")).agg(F.count("*").alias("g"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where((F.col("g") > lo) & (F.col("c0") < F.col("c1")))
        current = materialise(current.join(open_, F.col("token") == F.col("ot")).select("token", "node", "n", "pos", "comp"), "open-lists")
        if current.isEmpty():
            return labels
        # A set's pivot is a highly similar set: the first of those it links with, which its neighbours are likely to share, else the nearest.
        far = F.when(F.col("linked"), -1.0).otherwise(-F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("far")
        both = checked.select(F.col("a").alias("v"), F.struct(far, F.col("b").alias("p"), "both", F.col("nb").alias("pn"), F.col("na").alias("vn")).alias("s")).unionByName(
            checked.select(F.col("b").alias("v"), F.struct(far, F.col("a").alias("p"), "both", F.col("na").alias("pn"), F.col("nb").alias("vn")).alias("s"))
        )
        pivots = both.groupBy("v").agg(F.min("s").alias("s"))
        needed = current.select(F.col("node").alias("need")).distinct()
        facts = parities.join(needed, F.col("pnode") == F.col("need"), "left_semi").join(pivots, F.col("pnode") == F.col("v"), "left")
        own = F.col("s").isNull() | (F.col("node") < F.col("s.p")) | (F.col("s.vn") != F.col("n"))
        left = current.join(facts, (F.col("node") == F.col("pnode")) & (F.col("n") == F.col("pn"))).select(
            "token", "node", "n", "pos", "parity", "comp",
            F.when(own, F.col("node")).otherwise(F.col("s.p")).alias("pivot"),
            F.when(own, F.col("n")).otherwise(F.col("s.both")).alias("pov"),
            F.when(own, F.col("n")).otherwise(F.col("s.pn")).alias("pn"),
        )
        pairs = materialise(
            left.repartition("token").sortWithinPartitions("token", "n", "node").mapInArrow(_window_pairs(lo, hi, num, den), "a long, b long, known boolean")
            .groupBy("a", "b").agg(F.max("known").alias("known")), "pairs"
        )
        fresh = pairs.where("NOT known").join(checked.select("a", "b"), ["a", "b"], "left_anti")
        found = _checked(fresh, sets, num, den)
        links = links.unionByName(found.where("linked").select("a", "b")).unionByName(pairs.where("known").select("a", "b"))
        checked = checked.unionByName(found)
        current = current.drop("comp")
        lo, hi = hi, hi * WINDOW_GROWTH


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [list_aggregate(ws, 'string_agg', chr(10))]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: list_aggregate(ws[i:i + 3], 'string_agg', chr(10)))) END AS sh FROM w),
u AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS shared
      FROM u x JOIN u y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(c.root, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) c ON c.doc_id = s.doc_id
"""
