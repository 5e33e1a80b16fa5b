"""Join of documents on the Jaccard similarity of their word shingles.

Two documents link when ``100 * |A & B| >= 80 * |A | B|``. Every such pair is found
and no other, up to clashes of hashes: a shingle stands by 52 bits of a hash, so of
10^11 distinct shingles one in 45,000 is taken for another, and a class of equal sets
by 64 bits of a sum. The result is one row per document with the component of the
link graph it is in.

1. Sets. Tasks hash the shingles of a few hundred documents at a time (a chunk)
   and send each token's local postings, packed and compressed, to the token's
   range. There the number of documents of each token is known; tokens of one
   document only can never match and stop here, the rest returns to its chunk. The
   number of ranges follows the bytes of text. The head of a chunk (its documents)
   goes past the ranges, and the order of a task's rows must not change when it is run again. A
   token that is frequent inside a chunk sends its count alone and leaves its
   postings with the chunk, so a hot token costs a range one entry per chunk.
2. Classes. Equal sets are one class, named by a 64-bit digest of the set. Only
   classes whose repeated tokens reach 80 % of their set go on.
3. Prefixes. With tokens from rare to frequent, two linked sets share a token in
   their first ``n - ceil(0.8 n) + 1``. These (token, class) rows are the index.
4. Anchors. Every class is compared with one class of each list it is in: a star
   for each list, never its pairs. Verified links give labels; a few more rounds
   with other anchors compare what differs in label from its anchor.
5. Rest. Lists with one label hold no new link for components and are skipped
   whole. In the others, the classes of a large label form blocks that are skipped
   or met as one; what is left is joined between labels, by blocks of similar set
   size and with the positional bound. A pair's answer is derived from the answer of the
   sets its two sides were matched to before wherever that answer, plus or minus
   the known differences, already decides; the others are intersected.
6. Links found in a round join labels: components are searched in the graph of labels alone,
   by repeated minimum over neighbours, and classes get the label their label now has.

Defined results: a null, empty or blank text has 0 shingles and is its own
component, as is any text without a link; equal texts with words link. Every row
is a document, also if its doc_id is repeated or null; a component of null ids
only is null. Very long texts and other columns change nothing; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels
from .components import component_stars
from .store import apart, cut

PERCENT = 80
SHINGLE = 5
#: A token of at least so many documents of a chunk leaves its postings there.
LOCAL = 32
#: Rounds in which every class meets one class of each of its lists.
STARS = 4
#: Labels of at least LARGE classes are met in blocks of about BLOCK classes.
LARGE, BLOCK = 16, 256
#: A component with one in so many of all rows is large.
LARGE_SHARE = 1000
CHUNK_DOCS, CHUNK_BYTES = 4000, 4 << 20
#: Text whose postings meet in one range, about.
RANGE_BYTES = 8 << 20
#: Bits of a chunk's document number and of a token, together 64. 12 bits are room for CHUNK_DOCS.
DOC_BITS, TOKEN_BITS = 12, 52
_U = np.uint64


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed: high planes of small numbers cost nothing."""
    head = np.array([[len(a), a.itemsize, ord(a.dtype.kind)] for a in arrays], dtype=np.int64).tobytes()
    planes = [a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    return len(arrays).to_bytes(1, "little") + zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data[1:])
    head = np.frombuffer(raw, np.int64, 3 * data[0]).reshape(-1, 3)
    at, out = head.nbytes, []
    for n, size, kind in head.tolist():
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"{chr(kind)}{size}"))
        at += n * size
    return out


def _delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=_U(0))


def _chunk_rows(chunk: int, ids: np.ndarray, known: np.ndarray, keys: np.ndarray, tokens: np.ndarray, doc: np.ndarray, n_ranges: int):
    """The messages of one chunk: (range, chunk, kind, payload). Kind 0 heads the chunk and is a range of its own, kind 1 holds postings."""
    n = len(ids)
    both = np.unique(((tokens >> _U(DOC_BITS)) << _U(DOC_BITS)) | doc.astype(np.uint64))
    tok, doc = both >> _U(DOC_BITS), (both & _U((1 << DOC_BITS) - 1)).astype(np.uint16)
    count = np.bincount(doc, minlength=n)
    order = np.argsort(doc, kind="stable")
    ends = np.concatenate([[0], np.cumsum(count)])
    mixed = kernels.mix(tok + _U(1))
    marks = []
    for values in (mixed, kernels.mix(mixed)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[order])])
        marks.append(sums[ends[1:]] - sums[ends[:-1]])
    first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, np.int64)
    uniq, local = tok[first], np.diff(np.concatenate([first, [len(tok)]]))
    frequent = np.repeat(local >= LOCAL, local)
    rows = [(-1 - chunk, chunk, 0, _pack(ids, known, keys, count.astype(np.uint32), *marks, tok[frequent], doc[frequent]))]
    where = ((uniq >> _U(TOKEN_BITS - 32)) * _U(n_ranges)) >> _U(32)
    cuts = np.searchsorted(where, np.arange(n_ranges + 1, dtype=np.uint64))
    starts = np.concatenate([first, [len(tok)]])
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[r], cuts[r + 1]
        inside = slice(starts[a], starts[b])
        rows.append((r, chunk, 1, _pack(_delta(uniq[a:b]), local[a:b].astype(np.uint32), doc[inside][~frequent[inside]])))
    return rows


MESSAGES = "range long, chunk long, kind int, payload binary"


def _messages(batches, n_ranges: int):
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        known = np.asarray(ids.is_valid()).astype(np.uint8)
        keys = np.asarray(batch.column(batch.schema.get_field_index("row_key"))).astype(np.int64)
        ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        held: list = []
        size = docs = 0

        def flush():
            nonlocal chunk, size, docs
            tokens, doc, *own = (np.concatenate(x) for x in zip(*held, strict=True))
            rows = _chunk_rows(chunk, *own, tokens, doc, n_ranges)
            held.clear()
            chunk, size, docs = chunk + 1, 0, 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["range", "chunk", "kind", "payload"])

        for texts in kernels.slices(column):
            for a in range(0, len(texts), CHUNK_DOCS):
                b = min(len(texts), a + CHUNK_DOCS)
                part = kernels.Texts(texts.data[texts.offsets[a] : texts.offsets[b]], texts.offsets[a : b + 1] - texts.offsets[a], texts.first + a)
                if held and (size + len(part.data) > CHUNK_BYTES or docs + len(part) > CHUNK_DOCS):
                    yield flush()
                sh, at = kernels.shingle_sets(part, SHINGLE)
                span = slice(part.first, part.first + len(part))
                held.append((sh, at + docs, ids[span], known[span], keys[span]))
                size, docs = size + len(part.data), docs + len(part)
        if held:
            yield flush()


def _count_range(table: pa.Table) -> pa.Table:
    """Postings of the tokens of a range that more than one document holds, back to their chunks."""
    kinds = table.column("kind").to_pylist()
    chunks, payloads = table.column("chunk").to_pylist(), table.column("payload")
    out = [(chunks[i], 0, payloads[i].as_py()) for i, k in enumerate(kinds) if k == 0]
    parts = [(chunks[i], *_unpack(payloads[i].as_py())) for i, k in enumerate(kinds) if k == 1]
    if parts:
        toks = [np.cumsum(p[1], dtype=np.uint64) for p in parts]
        uniq, back = np.unique(np.concatenate(toks), return_inverse=True)
        df = np.bincount(back, weights=np.concatenate([p[2] for p in parts]), minlength=len(uniq)).astype(np.int64)
        at = 0
        for (chunk, _, local, doc), tok in zip(parts, toks, strict=True):
            n = df[back[at : at + len(tok)]]
            at += len(tok)
            keep = n > 1
            if keep.any():
                sent = np.where(local < LOCAL, local, 0)
                docs = doc[np.repeat(keep, sent)]
                out.append((chunk, 1, _pack(_delta(tok[keep]), np.minimum(n[keep], 2**32 - 1).astype(np.uint32), sent[keep].astype(np.uint32), docs)))
    cols = list(zip(*out, strict=True)) or [[], [], []]
    return pa.table({"chunk": pa.array(cols[0], pa.int64()), "kind": pa.array(cols[1], pa.int32()), "payload": pa.array(cols[2], pa.binary())})


SETS = "doc_id long, row_key long, n long, mark_a long, mark_b long, tokens array<long>"


def _chunk_sets(table: pa.Table) -> pa.Table:
    """One row per document of a chunk; its repeated tokens, rare first, if it can have a partner."""
    kinds, payloads = table.column("kind").to_pylist(), table.column("payload")
    heads = [_unpack(payloads[i].as_py()) for i, k in enumerate(kinds) if k == 0]
    toks, dfs, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint16)]
    words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for i, k in enumerate(kinds):
        if k == 1:
            delta, df, sent, doc = _unpack(payloads[i].as_py())
            tok = np.cumsum(delta, dtype=np.uint64)
            toks.append(np.repeat(tok, sent))
            dfs.append(np.repeat(df, sent))
            docs.append(doc)
            words.append(tok[sent == 0])
            counts.append(df[sent == 0])
    frequent, often = np.concatenate(words), np.concatenate(counts)
    order = np.argsort(frequent)
    frequent, often = frequent[order], often[order]
    rows = []
    for ids, known, keys, n, mark_a, mark_b, ftok, fdoc in heads:
        fdf = often[np.searchsorted(frequent, ftok)] if len(ftok) else np.zeros(0, np.uint32)
        tok, df, doc = np.concatenate([*toks, ftok]), np.concatenate([*dfs, fdf]), np.concatenate([*docs, fdoc])
        repeated = np.bincount(doc, minlength=len(ids))
        able = (n > 0) & (100 * repeated >= PERCENT * n.astype(np.int64))
        use = able[doc]
        tok, df, doc = tok[use], df[use], doc[use]
        order = np.lexsort((tok, df, doc))
        tok = tok[order].astype(np.int64)
        ends = np.cumsum(np.where(able, repeated, 0))
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        tokens = pa.ListArray.from_arrays(offsets, pa.array(tok, pa.int64()))
        rows.append(pa.table({"doc_id": pa.array(ids, mask=known == 0), "row_key": keys, "n": n.astype(np.int64), "mark_a": mark_a.view(np.int64), "mark_b": mark_b.view(np.int64), "tokens": tokens}))
    empty = {"doc_id": pa.array([], pa.int64()), "row_key": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "mark_a": pa.array([], pa.int64()), "mark_b": pa.array([], pa.int64()), "tokens": pa.array([], pa.list_(pa.int64()))}
    return pa.concat_tables(rows) if rows else pa.table(empty)


def shingle_sets(documents: DataFrame) -> DataFrame:
    """doc_id, row_key, n (set size), mark_a, mark_b (equal for equal sets), tokens (empty if no partner is possible)."""
    n_bytes = documents.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n_ranges = 1 + n_bytes // RANGE_BYTES
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    sent = rows.mapInArrow(lambda batches: _messages(batches, n_ranges), MESSAGES)
    counted = sent.groupBy("range").applyInArrow(_count_range, "chunk long, kind int, payload binary")
    return counted.groupBy("chunk").applyInArrow(_chunk_sets, SETS)


def row_key(doc_id: Column, text: Column) -> Column:
    """Equal for rows of equal doc_id and text, null or not."""
    return F.xxhash64(doc_id.cast("long"), text.cast("string"), doc_id.isNull(), text.isNull())


def _needed(n: Column) -> Column:
    """The least size of a linked set, and of what both share."""
    return F.ceil(n * PERCENT / F.lit(100)).cast("long")


def _linked(shared: Column, a: Column, b: Column) -> Column:
    return shared * 100 >= (a + b - shared) * PERCENT


def _shared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with na, nb and the size of the intersection."""
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.withColumn("shared", F.size(F.array_intersect("ta", "tb")).cast("long")).drop("ta", "tb")


def _block_links(named: DataFrame, labels: DataFrame, sizes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of labels (la, lb) linked by a class of one and a class of the other, which has many classes.

    The classes of a label that share a list are one entry of it, with the widest
    of their bounds: a class whose bounds miss the entry's skips the block whole.
    The others are intersected with the block's classes in one task.
    """
    entry = [F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.max(F.col("n") - F.col("pos")).alias("left_max")]
    blocks = named.where("part is not null").groupBy("token", F.col("label").alias("to"), F.col("part").alias("to_part")).agg(*entry)
    rows = named.join(blocks, "token").where((F.col("label") != F.col("to")) & (F.col("part").isNull() | (F.col("label") < F.col("to"))))
    fits = (F.col("n") * 100 >= F.col("n_min") * PERCENT) & (F.col("n_max") * 100 >= F.col("n") * PERCENT)
    least = F.ceil((F.col("n") + F.greatest(F.col("n_min"), _needed(F.col("n")))) * PERCENT / F.lit(100 + PERCENT))
    met = rows.where(fits & (F.least(F.col("n") - F.col("pos"), F.col("left_max")) >= least)).select("rep", "label", "to", "to_part").distinct()
    many = met.groupBy("to", "to_part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("shares"))
    met = cut(met)
    guests = met.join(many, ["to", "to_part"]).join(sets, "rep").select("to", "to_part", F.pmod(F.xxhash64("rep", F.lit(98)), F.col("shares")).cast("int").alias("share"), "label", "n", "tokens")
    part = F.pmod(F.xxhash64("rep", F.lit(99)), F.ceil(F.col("members") / BLOCK)).cast("int")
    hosts = labels.join(sizes, "label").select("rep", F.col("label").alias("to"), part.alias("to_part")).join(many, ["to", "to_part"]).join(sets, "rep")
    hosts = hosts.select("to", "to_part", F.explode(F.sequence(F.lit(0), F.col("shares").cast("int") - 1)).alias("share"), "n", "tokens")
    key = ["to", "to_part", "share"]
    return guests.groupBy(*key).cogroup(hosts.groupBy(*key)).applyInArrow(_meet, "la long, lb long").distinct()


def _meet(guests: pa.Table, hosts: pa.Table) -> pa.Table:
    """The labels of guests that link to a host, by counting the hosts of each of their tokens."""
    out = []
    if guests.num_rows and hosts.num_rows:
        lists = hosts.column("tokens").combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        token, n_hosts = np.asarray(lists.flatten()), hosts.num_rows
        host = np.repeat(np.arange(n_hosts), np.asarray(pc.list_value_length(lists)))
        order = np.argsort(token, kind="stable")
        token, host = token[order], host[order]
        n, to = np.asarray(hosts.column("n")), hosts.column("to")[0].as_py()
        for label, m, own in zip(guests.column("label").to_pylist(), guests.column("n").to_pylist(), guests.column("tokens"), strict=True):
            own = np.asarray(own.values)
            lo, hi = np.searchsorted(token, own), np.searchsorted(token, own, side="right")
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
            shared = np.bincount(host[at], minlength=n_hosts)
            if (100 * shared >= PERCENT * (n + m - shared)).any():
                out.append((label, to))
    cols = list(zip(*out, strict=True)) or [[], []]
    return pa.table({"la": pa.array(cols[0], pa.int64()), "lb": pa.array(cols[1], pa.int64())})


def _relabelled(labels: DataFrame, linked: DataFrame) -> DataFrame | None:
    """(rep, label) after labels (la, lb) were found linked, None if none was: only the graph of labels is searched for components."""
    stars = component_stars(linked, "la", "lb")
    if stars is None:
        return None
    moved = labels.join(stars.withColumnRenamed("node", "label"), "label", "left")
    return cut(moved.select("rep", F.coalesce("component", "label").alias("label")))


def similarity_labels(sets: DataFrame) -> DataFrame:
    """(rep, label) of every class: label is the smallest rep it reaches. ``sets`` has rep, n and tokens."""
    front = F.col("n") - _needed(F.col("n")) + 1 - (F.col("n") - F.size("tokens"))
    own = sets.where(front > 0).withColumn("front", F.slice("tokens", 1, front.cast("int")))
    index = own.select("rep", "n", (F.col("n") - F.size("tokens")).alias("alone"), F.posexplode("front").alias("pos", "token"))
    index = cut(index.select("token", "rep", "n", (F.col("alone") + F.col("pos")).alias("pos")))
    near = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * PERCENT
    labels, links = sets.select("rep", F.col("rep").alias("label")), None
    for turn in range(STARS):
        named = index.join(labels, "rep") if turn else index.withColumn("label", F.col("rep"))
        head = F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("at"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))).alias("head")
        lists = named.groupBy("token").agg(head, F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token", "head.*")
        pairs = named.join(lists, "token").where((F.col("label") != F.col("lb")) & near("n", "nb"))
        found = _shared(pairs.select(F.col("rep").alias("a"), "b", F.col("label").alias("la"), "lb").distinct(), sets).where(_linked(F.col("shared"), F.col("na"), F.col("nb")))
        found = cut(found.select("a", "b", "na", "nb", "shared", "la", "lb"))
        links = found if links is None else links.unionByName(found)
        moved = _relabelled(labels, found)
        if moved is None:
            break
        labels = moved
    # what is left: lists that hold more than one label
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= LARGE)
    named = index.join(labels, "rep")
    mixed = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    part = F.when(F.col("members").isNotNull(), F.pmod(F.xxhash64("rep", F.lit(99)), F.ceil(F.col("members") / BLOCK))).cast("int")
    named = cut(named.join(mixed, "token").join(sizes, "label", "left").withColumn("part", part).drop("members"))
    blocks = _block_links(named, labels, sizes, sets)
    named = named.where("part is null")  # both sides small
    # of a list's (size, position) values, however many classes have them, the pairs that can still meet the bound
    block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT))).cast("int")
    values = named.groupBy("token", "n", "pos").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).withColumn("block", block)
    others = values.select("token", F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"))
    n, m = F.col("n"), F.col("n2")
    least = F.ceil((n + m) * PERCENT / F.lit(100 + PERCENT))  # shared tokens of a linked pair
    bound = F.least(n - F.col("pos"), m - F.col("pos2"))
    differ = (F.col("lo") != F.col("hi")) | (F.col("lo2") != F.col("hi2")) | (F.col("lo") != F.col("lo2"))
    values = values.join(others, ["token", "block"]).where(differ & near("n", "n2") & (bound >= least)).select("token", "n", "pos", "n2", "pos2")
    right = named.select("token", F.col("rep").alias("b"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("label").alias("lb"))
    rest = named.join(values, ["token", "n", "pos"]).join(right, ["token", "n2", "pos2"]).where((F.col("rep") < F.col("b")) & (F.col("label") != F.col("lb")))
    rest = cut(rest.select(F.col("rep").alias("a"), "b", F.col("label").alias("la"), "lb", F.col("n").alias("na"), F.col("n2").alias("nb")).distinct())
    best = links.groupBy("a").agg(F.max_by(F.struct("b", "na", "nb", "shared"), F.struct("shared", "b")).alias("m"))
    match = best.select("a", F.col("m.b").alias("to"), (F.col("m.na") - F.col("m.shared")).alias("less"), (F.col("m.nb") - F.col("m.shared")).alias("more"))
    for side, name in (("a", "x"), ("b", "y")):
        rest = rest.join(match.select(F.col("a").alias(side), F.col("to").alias(f"{name}_to"), F.col("less").alias(f"{name}_less"), F.col("more").alias(f"{name}_more")), side, "left")
        rest = rest.withColumn(f"{name}_to", F.coalesce(f"{name}_to", side)).na.fill(0, [f"{name}_less", f"{name}_more"])
    matched = rest.where("x_to <> a or y_to <> b")
    known = _shared(matched.select(F.col("x_to").alias("a"), F.col("y_to").alias("b")).distinct(), sets)
    known = known.select(F.col("a").alias("x_to"), F.col("b").alias("y_to"), "shared")
    rest = rest.join(known, ["x_to", "y_to"], "left")
    most = F.col("shared") + F.col("x_less") + F.col("y_less")
    fewest = F.col("shared") - F.col("x_more") - F.col("y_more")
    yes, no = _linked(fewest, F.col("na"), F.col("nb")), ~_linked(most, F.col("na"), F.col("nb"))
    rest = cut(rest.withColumn("known", F.when(F.col("shared").isNull(), F.lit(None)).when(yes, True).when(no, False)).select("a", "b", "la", "lb", "known"))
    checked = _shared(rest.where("known is null").drop("known"), sets).where(_linked(F.col("shared"), F.col("na"), F.col("nb")))
    last = blocks.unionByName(rest.where("known").select("la", "lb")).unionByName(checked.select("la", "lb"))
    moved = _relabelled(labels, last)
    return labels if moved is None else moved


def similarity_components(documents: DataFrame) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id, first_key: one row per row of ``documents``.

    ``first_key`` is the row_key of the row that stands for the component.
    """
    marks = ["n", "mark_a", "mark_b"]
    sets = cut(shingle_sets(documents))
    able = sets.where("n > 0 and size(tokens) > 0").dropDuplicates(marks)
    found = similarity_labels(cut(able.select(_node().alias("rep"), "n", "tokens"))).select(F.col("rep").alias("node"), F.col("label").alias("component"))
    rows = sets.select("doc_id", "row_key", "n", F.when(F.col("n") > 0, _node()).alias("node")).join(found, "node", "left")
    rows = cut(rows.select("doc_id", "row_key", "n", F.coalesce("component", "node").alias("component")))
    n_rows = rows.count()
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first")
    first = cut(rows.where("component is not null").groupBy("component").agg(best, F.count(F.lit(1)).alias("members")))
    # components of a thousandth of all rows or more, a thousand at most, are looked up without dealing out their rows
    large = F.broadcast(first.where(F.col("members") * LARGE_SHARE >= n_rows).drop("members"))
    some = rows.where("component is not null")
    inside = some.join(large, "component").unionByName(some.join(large, "component", "left_anti").join(first.drop("members"), "component"))
    none = rows.where("component is null").select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("row_key").alias("first_key"))
    return inside.select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), F.col("first.row_key").alias("first_key")).unionByName(none)


def deduplicate(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` less all but the first document of each component.

    Keys are decided on narrow rows, and texts are dealt out once to meet them. Of rows that
    repeat both doc_id and text one stays. A row that is a thousandth of all those or more
    is reduced where it is read, so its repeats never meet in one task.
    """
    kept = cut(similarity_components(documents).where("row_key = first_key").groupBy("row_key").agg(F.count(F.lit(1)).alias("times")))
    n_rows = kept.agg(F.sum("times")).first()[0] or 0
    large = kept.where((F.col("times") > 1) & (F.col("times") * LARGE_SHARE >= n_rows))
    hot = [r["row_key"] for r in large.select("row_key").collect()]  # LARGE_SHARE rows at most
    base, of, columns = apart(documents)
    rows = base.withColumn("row_key", row_key(of["doc_id"], of["text"]))
    is_hot = F.col("row_key").isin(hot) if hot else F.lit(False)
    rest = rows.where(~is_hot)
    single, again = (rest.join(kept.where(which).select("row_key").hint("shuffle_hash"), "row_key") for which in ("times = 1", "times > 1"))
    again = again.withColumn("again", F.row_number().over(W.partitionBy("row_key", of["doc_id"]).orderBy("row_key"))).where("again = 1")
    out = single.unionByName(again.drop("again"))
    if hot:
        one = rows.where(is_hot).groupBy("row_key", of["doc_id"].alias("id")).agg(F.first(F.struct(*base.columns)).alias("r"))
        out = out.unionByName(one.select("r.*", "row_key"))
    return out.select(*columns)


def _node() -> Column:
    """The name of a class of equal sets."""
    return F.col("mark_a")


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similarity_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
