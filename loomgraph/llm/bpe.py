"""Byte-level BPE: a global shuffle of distinct words.

Every Arrow batch of documents becomes one block: the stream of its pre-tokens, as indexes into the block's own distinct
words, and those words, dealt by hash to word buckets. A bucket sees the words of all blocks, encodes each distinct word
once and sends the ids back to the blocks; a block then puts ids and decoded bytes together by position. Rows of the two
shuffles are packed and compressed word lists, not single words: single (block, word) rows need over twice the disk. A very
frequent word reaches its bucket once a block, not once an occurrence, so that no word is hot.

Decoding joins the ids with the token-byte table, whose size the vocabulary bounds.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from loomgraph.llm.common import give_back, partitions, pieces, slices

#: Bytes of text, or pre-tokens, that a task handles at a time.
SLICE = 2_000_000
PACKED = "block string, target string, kind int, bucket int, n int, keys binary, counts binary, ranks binary, pack binary"


@functools.lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids. The file is part of every node's installation; its path is a parameter."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the neighbouring pair of lowest rank is merged, leftmost first, until none has a rank."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 48:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same for long words, with a heap of pairs over a linked list: n log n instead of n squared."""
    after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
    alive: list[bytes | None] = list(parts)
    heap = [(rank, i, 1, 1) for i in range(len(parts) - 1) if (rank := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)

    def push(i: int) -> None:
        j = after[i]
        if j >= 0 and (rank := ranks.get(alive[i] + alive[j])) is not None:
            heapq.heappush(heap, (rank, i, len(alive[i]), len(alive[j])))

    while heap:
        _, i, left, right = heapq.heappop(heap)
        if alive[i] is None or len(alive[i]) != left or (j := after[i]) < 0 or len(alive[j]) != right:
            continue
        alive[i], alive[j], after[i] = alive[i] + alive[j], None, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [ranks[p] for p in alive if p is not None]


def _pack(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.compress(sizes.tobytes() + b"".join(words), 3)


def _unpack(pack: bytes, n: int) -> list[bytes]:
    raw = zstandard.decompress(pack)
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.frombuffer(raw, np.uint32, n), dtype=np.int64)]) + 4 * n
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _planes(codes: np.ndarray) -> bytes:
    """32-bit integers by byte plane, which a general compressor shrinks to about their entropy."""
    return zstandard.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _from_planes(pack: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(pack), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every (start, size), one after the other."""
    out = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return out + np.arange(len(out))


def pretokens(texts: pa.Array, pattern, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(code of every pre-token, number of pre-tokens of each text); `words` holds the codes and gains the new words.

    Texts are cut before single spaces first, so that the pattern runs once over each distinct chunk (a space and what
    follows up to the next one). Where a space has white space on both sides, a match can cross the cut; such neighbouring
    chunks make their text go through the pattern as a whole.
    """
    chunked = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
    ends = chunked.offsets.to_numpy().astype(np.int64)
    coded = chunked.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    ends -= ends[0]
    codes, chunks = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    blank = np.array([[not c or c[0].isspace(), not c or c[-1].isspace()] for c in chunks], bool).reshape(-1, 2)
    text_of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    first = np.zeros(len(codes), bool)
    first[ends[:-1][np.diff(ends) > 0]] = True
    crossing = blank[codes[:-1], 1] & blank[codes[1:], 0] & ~first[1:]
    whole = np.unique(text_of[1:][crossing])

    found: list[int] = []
    sizes: list[int] = []

    def cut(chunk: str) -> None:
        parts = pattern.findall(chunk)
        found.extend(words.setdefault(p, len(words)) for p in parts)
        sizes.append(len(parts))

    keys = codes + np.where(first, len(chunks), 0)  # a text's first chunk has no space before it
    keys[np.isin(text_of, whole)] = -1
    used, inverse = np.unique(keys, return_inverse=True)
    for k in used.tolist():
        cut("" if k < 0 else " " + chunks[k] if k < len(chunks) else chunks[k - len(chunks)])
    for t in whole.tolist():
        cut(texts[t].as_py())
    inverse[ends[:-1][whole]] = len(used) + np.arange(len(whole))
    size_of, codes_found = np.array(sizes, np.int64), np.array(found, np.int64)
    starts = np.concatenate([[0], np.cumsum(size_of)[:-1]]).astype(np.int64)
    stream = codes_found[_spread(starts[inverse], size_of[inverse])] if len(inverse) else codes_found
    counts = np.bincount(text_of, weights=size_of[inverse], minlength=len(ends) - 1).astype(np.int64)
    return stream.astype(np.uint32), counts


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(doc_id long, ids array<int>), one row per row of `docs`.

    A null text counts as empty: no ids, empty bytes. Repeated rows and ids stay, null ids too. Other columns are not read,
    whatever their names. Order of rows within an id is not defined; every row is encoded on its own.
    """
    spark = docs.sparkSession
    buckets = buckets or partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, schema = regex.compile(pattern), None
        part = TaskContext.get().partitionId()
        for at, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            texts, known = batch.column("text"), {}
            stream, counts = (np.concatenate(x) for x in zip(*(pretokens(part, compiled, known) for part in pieces(texts, SLICE)), strict=True))
            words = [w.encode() for w in known]
            del known
            block = f"{part}-{at}"
            keys = pa.table({"key": batch.column("key")})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, keys.schema) as writer:
                writer.write_table(keys)
            bucket_of = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
            lists: list[list[bytes]] = [[] for _ in range(buckets)]
            order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
            for w in order.tolist():
                lists[bucket_of[w]].append(words[w])
            # a word's index: bucket by bucket, sorted within
            index = np.empty(len(words), np.int64)
            index[order[np.argsort(bucket_of[order], kind="stable")]] = np.arange(len(words))
            by_rank = np.argsort(-np.bincount(stream, minlength=len(words)), kind="stable")  # frequent words get small numbers, which compress
            rank = np.empty(len(words), np.int64)
            rank[by_rank] = np.arange(len(words))
            filled = [b for b in range(buckets) if lists[b]]
            out = {
                "block": [block] * (1 + len(filled)), "target": ["b" + block, *(f"w{b}" for b in filled)],
                "kind": [0, *[1] * len(filled)], "bucket": [-1, *filled], "n": [len(stream), *(len(lists[b]) for b in filled)],
                "keys": [sink.getvalue().to_pybytes(), *[None] * len(filled)],
                "counts": [counts.astype("<i8").tobytes(), *[None] * len(filled)],
                "ranks": [_planes(index[by_rank]), *[None] * len(filled)],
                "pack": [_planes(rank[stream]), *(_pack(lists[b]) for b in filled)],
            }
            schema = schema or pa.schema([("block", pa.string()), ("target", pa.string()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("ranks", pa.binary()), ("pack", pa.binary())])
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    def encoded(table: pa.Table) -> pa.Table:
        """A bucket: every distinct word once; a block's own row passes through."""
        give_back()
        if table.column("kind")[0].as_py() == 0:
            return table
        ranks, known = read_ranks(ranks_path), {}
        packs = []
        for n, pack in zip(table.column("n").to_pylist(), table.column("pack").to_pylist(), strict=True):
            lists = []
            for word in _unpack(pack, n):
                if (ids := known.get(word)) is None:
                    ids = known[word] = np.array(merge_word(word, ranks), "<u4").tobytes()
                lists.append(ids)
            packs.append(_pack(lists))
        return table.set_column(table.schema.get_field_index("pack"), pa.field("pack", pa.binary()), pa.array(packs, pa.binary()))

    def assembled(table: pa.Table) -> pa.Table:
        """A block: ids of its words, by position; then the bytes of the ids."""
        give_back()
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        own, lists = rows[0], [ids for r in rows[1:] for ids in _unpack(r["pack"], r["n"])]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        ids_of = np.frombuffer(b"".join(lists), "<u4")
        index, counts = _from_planes(own["ranks"])[_from_planes(own["pack"])], np.frombuffer(own["counts"], "<i8")
        starts = np.cumsum(sizes) - sizes
        ids, lengths = [], [np.zeros(1, np.int64)]
        for a in range(0, len(index), SLICE):
            part = index[a : a + SLICE]
            ids.append(ids_of[_spread(starts[part], sizes[part])].astype(np.int32))
            lengths.append(np.cumsum(sizes[part]) + lengths[-1][-1])
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        token_ends = np.concatenate(lengths)[np.concatenate([[0], np.cumsum(counts)])]
        keys = pa.ipc.open_stream(own["keys"]).read_all().column("key").combine_chunks()
        return pa.table({
            "doc_id": keys,
            "ids": pa.ListArray.from_arrays(pa.array(token_ends, pa.int32()), pa.array(ids)),
        })

    out = StructType([StructField("doc_id", LongType()), StructField("ids", ArrayType(IntegerType()))])
    packed = rows.mapInArrow(blocks, PACKED)
    return packed.groupBy("target").applyInArrow(encoded, PACKED).groupBy("block").applyInArrow(assembled, out)


def token_bytes(ranks_path: str) -> pa.BinaryArray:
    """The token-byte table: row i holds the bytes of id i."""
    ranks = read_ranks(ranks_path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.binary())


def decoded_bytes(ids: pa.ListArray, table: pa.BinaryArray) -> pa.BinaryArray:
    """The bytes of every list of ids: each id meets its row of the token-byte table, in its position."""
    flat = ids.flatten()
    found = pc.take(table, flat)
    if found.null_count:
        raise ValueError("an id is not in the vocabulary")
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    byte_ends = np.concatenate([[0], np.cumsum(pc.binary_length(found).to_numpy(zero_copy_only=False), dtype=np.int64)])
    ends = byte_ends[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])].astype(np.int32)
    raw = found.buffers()[2] or pa.py_buffer(b"")
    whole = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), raw])
    return pc.if_else(pc.is_null(ids), pa.scalar(None, pa.binary()), whole)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds `decoded` (binary) to rows with `doc_id` and `ids`: a join of every id with the token-byte table, by position.

    The table has a row per vocabulary entry, so every task holds it whole. An id outside of the vocabulary is an error. Null
    ids give null bytes, no ids give empty bytes.
    """
    schema = StructType([*encoded.select("doc_id", "ids").schema.fields, StructField("decoded", BinaryType())])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks_path)
        for batch in batches:
            ids = batch.column("ids")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, decoded_bytes(ids, table)], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(joined, schema)


def digests(encoded: DataFrame, ranks_path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of encoded rows: their ids, decoded again in the same pass.

    Ids are hashed as little-endian unsigned 32-bit integers. One Python worker a task does both, as `decode` and a second
    step would hold two workers' memory.
    """
    fields = [StructField("doc_id", LongType()), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    fields += [StructField("ids", ArrayType(IntegerType()))] * with_ids

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks_path)
        for batch in batches:
            ids, ends = batch.column("ids"), batch.column("ids").offsets.to_numpy()
            for a, b in slices(np.diff(ends), SLICE // 4):  # small batches out, as each is held on both sides
                part, size = ids.slice(a, b - a), np.diff(ends[a : b + 1])
                flat = part.flatten().to_numpy(zero_copy_only=False).astype("<u4")
                first = [hashlib.sha256(flat[x - ends[a] : y - ends[a]]).hexdigest() for x, y in zip(ends[a:b], ends[a + 1 : b + 1], strict=True)]
                second = [hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded_bytes(part, table)]
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(size, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *[part] * with_ids], [f.name for f in fields])
            give_back()

    return encoded.mapInArrow(hashed, StructType(fields))
