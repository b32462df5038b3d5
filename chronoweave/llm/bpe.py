"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into pre-tokens; a block of texts keeps, per text, the positions of its words as
indexes into the block's own list of distinct words.  Blocks are written once.  Their lists, not every
occurrence, go through one shuffle by word: each distinct word of the corpus is encoded once, in one
task (a word of very many blocks by several).  The ids go back to the blocks, where texts are
reassembled by position, piece by piece.  Decoding looks ids up in the token-byte table, whose size is the
vocabulary's.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.storage import drop, written
from chronoweave.llm.workers import FEW_ROWS, give_back

#: A block ends when its texts have so many characters: bounds a worker's memory.
BLOCK_CHARS = 40_000_000
#: Longer texts are read match by match, never as a list of all their words.
LONG_CHARS = 4_000_000
#: Words of a block that are packed, and read again, together.
WORDS = 20_000
#: Positions of words in texts that are packed, and read again, together.
PLACES = 1 << 18
_CACHE: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file (base64 token, rank) as a table from token to rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _tables(path: str, pattern: str):
    if (path, pattern) not in _CACHE:
        import tiktoken

        ranks = load_ranks(path)
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        byte_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            byte_of[rank] = token
        lens = np.array([len(x) for x in byte_of], np.int64)
        _CACHE[path, pattern] = enc, np.frombuffer(b"".join(byte_of), np.uint8), np.cumsum(lens) - lens, lens
    return _CACHE[path, pattern]


def _gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs ``flat[starts[i]:starts[i] + lens[i]]``, one after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts - (ends - lens), lens)
    at += np.arange(total)
    return flat[at]


def _blocks(pattern: str):
    """mapInPandas function: the distinct words, and the word positions, of each block.

    A block's id is drawn when it is read.  Only what a task wrote is ever read again, so a task that
    runs twice, on rows in another order even, leaves one set of whole blocks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = regex.compile(pattern)
        packer = zstandard.ZstdCompressor(level=3)
        block = uuid.uuid4().hex
        index: dict[str, int] = {}
        keys: list[str | None] = []
        sizes: list[int] = []
        places: list[np.ndarray] = []
        seen = held = piece = 0

        def packed(last: bool = False) -> pd.DataFrame:
            """A row of positions; keys and sizes of the block's texts stand in its last one."""
            nonlocal held, piece
            seq = np.concatenate(places) if places else np.zeros(0, np.int32)
            places.clear()
            # low and high bytes apart compress better than whole integers
            raw = seq.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            held, piece = 0, piece + 1
            return pd.DataFrame({"kind": ["places"], "block": [block], "n": [len(index)], "at": [piece - 1], "keys": [keys if last else None], "sizes": [sizes if last else None], "packed": [packer.compress(raw)]})

        def flush():
            nonlocal block, index, keys, sizes, seen, piece
            words = iter(index)
            at = 0
            while part := [w.encode() for w in itertools.islice(words, WORDS)]:
                raw = np.array([len(w) for w in part], "<u4").tobytes() + b"".join(part)
                yield pd.DataFrame({"kind": ["words"], "block": [block], "n": [len(part)], "at": [at], "keys": [None], "sizes": [None], "packed": [packer.compress(raw)]})
                at += len(part)
            yield packed(last=True)
            block, index, keys, sizes, seen, piece = uuid.uuid4().hex, {}, [], [], 0, 0

        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                text = text or ""
                number = index.setdefault
                count = 0
                words = iter(cut.findall(text)) if len(text) <= LONG_CHARS else (m[0] for m in cut.finditer(text))
                while found := [number(w, len(index)) for w in itertools.islice(words, PLACES)]:
                    count += len(found)
                    held += len(found)
                    places.append(np.array(found, np.int32))
                    if held >= PLACES:
                        yield packed()
                keys.append(None if key is None or key != key else str(key))
                sizes.append(count)
                seen += len(text)
                if seen >= BLOCK_CHARS:
                    yield from flush()
        if keys:
            yield from flush()
        index.clear()
        give_back()

    return run


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas function: a row for each distinct word of a block."""
    for pdf in batches:
        for block, n, at, packed in zip(pdf["block"], pdf["n"], pdf["at"], pdf["packed"], strict=True):
            raw = zstandard.ZstdDecompressor().decompress(packed)
            ends = 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64))
            starts = [4 * n, *ends[:-1].tolist()]
            yield pd.DataFrame({"block": block, "at": np.arange(at, at + n, dtype=np.int32), "word": [raw[a:b].decode() for a, b in zip(starts, ends.tolist(), strict=True)]})


def _encode_words(path: str, pattern: str):
    """mapInPandas function: ids of the words, packed into one row for a block and some rows read.

    A packed row holds the words' places in the block (ascending, as differences), their numbers of
    ids, and the ids.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _tables(path, pattern)[0]
        packer = zstandard.ZstdCompressor(level=1)
        last, ids = None, np.zeros(0, "<u4")
        held: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []

        def packed() -> pd.DataFrame:
            block = np.concatenate([x[0] for x in held])
            at = np.concatenate([x[1] for x in held])
            found = [i for x in held for i in x[2]]
            held.clear()
            _, block_no = np.unique(block, return_inverse=True)
            order = np.lexsort((at, block_no))
            cuts = np.flatnonzero(np.diff(block_no[order])) + 1
            rows = []
            for part in np.split(order, cuts):
                own = [found[i] for i in part]
                raw = np.concatenate([np.diff(at[part], prepend=0).astype("<u4"), np.array([len(x) for x in own], "<u4"), *own])
                rows.append((block[part[0]], len(part), packer.compress(raw.view(np.uint8).reshape(-1, 4).T.tobytes())))
            return pd.DataFrame(rows, columns=["block", "n", "packed"])

        for pdf in batches:
            out = []
            for word in pdf["word"]:
                if word != last:  # rows come sorted by word
                    last, ids = word, np.array(enc._encode_single_piece(word.encode()), "<u4")
                out.append(ids)
            held.append((pdf["block"].to_numpy(), pdf["at"].to_numpy(), out))
            if sum(len(x[1]) for x in held) >= 200_000:
                yield packed()
        if held:
            yield packed()
        give_back()

    return run


def _unpacked(words: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words in the block, where their ids start, their numbers of ids, all ids."""
    ats, lens, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for n, packed in zip(words["n"], words["packed"], strict=True):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
        ats.append(np.cumsum(raw[:n].astype(np.int64)))
        lens.append(raw[n : 2 * n].astype(np.int64))
        flat.append(raw[2 * n :])
    length = np.concatenate(lens)
    return np.concatenate(ats), np.cumsum(length) - length, length, np.concatenate(flat)


def _placed(packed: bytes) -> np.ndarray:
    """Indexes of words, as :func:`_blocks` packed them."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return raw.reshape(4, -1).T.copy().view("<u4").ravel() if len(raw) else np.zeros(0, "<u4")


def _runs(sizes: list[int], pieces: Iterator[np.ndarray]) -> Iterator[Iterator[np.ndarray]]:
    """For each size, in order, the next so many elements of ``pieces``, as slices of them.

    One piece is held at a time, whatever the sizes; each run is to be read before the next.
    """
    piece = np.zeros(0, "<u4")

    def run(n: int) -> Iterator[np.ndarray]:
        nonlocal piece
        while n:
            if not len(piece):
                piece = next(pieces)
                continue
            own, piece = piece[:n], piece[n:]
            n -= len(own)
            yield own

    for n in sizes:
        yield run(int(n))


def _assemble(path: str, pattern: str):
    def texts(places: pd.DataFrame, words: pd.DataFrame) -> Iterator[tuple[str | None, Iterator[tuple[np.ndarray, np.ndarray]]]]:
        """Each text's key, and its ids and decoded bytes piece by piece: no block is ever held whole."""
        if not len(places):
            raise RuntimeError("words came back without their block")
        _, byte_flat, byte_start, byte_len = _tables(path, pattern)
        at, starts, lens, flat = _unpacked(words)
        order = np.argsort(at, kind="stable")
        starts, lens = starts[order], lens[order]
        places = places.sort_values("at")
        last = places.iloc[-1]
        if last["n"] != len(starts):
            raise RuntimeError(f"a block of {last['n']} words came back with {len(starts)}")

        def piece(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ids = _gather(flat, starts[own], lens[own])
            return ids, _gather(byte_flat, byte_start[ids], byte_len[ids])

        for k, own in zip(last["keys"], _runs(last["sizes"], map(_placed, places["packed"])), strict=True):
            yield k, map(piece, own)

    def digest(key, places: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for k, pieces in texts(places, words):
            n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
            for ids, text in pieces:
                n += len(ids)
                of_ids.update(ids.astype("<u4", copy=False))
                of_text.update(text)
            rows.append((k, n, of_ids.hexdigest(), of_text.hexdigest()))
        give_back()
        return pd.DataFrame(rows, columns=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    def full(key, places: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for k, pieces in texts(places, words):
            got = list(pieces)
            ids = np.concatenate([np.zeros(0, np.int32), *[i.astype(np.int32) for i, _ in got]])
            rows.append((k, ids, b"".join(t.tobytes() for _, t in got).decode("utf-8", "replace")))
        return pd.DataFrame(rows, columns=["key", "ids", "decoded"])

    return digest, full


def _encoded(docs: DataFrame, key: str, text: str, path: str, pattern: str, whole: bool, nulls: int | None) -> DataFrame:
    # keys go as text: beside nulls pandas would make them floats
    src = docs.select(F.col(key).cast("long").cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    blocks = src.mapInPandas(_blocks(pattern), "kind string, block string, n int, at int, keys array<string>, sizes array<int>, packed binary")
    blocks = written(blocks, "bpe-blocks", "none", by="kind", conf=FEW_ROWS)
    n_blocks = blocks.where("kind = 'places' and at = 0").count()
    words = blocks.where("kind = 'words'").select("block", "n", "at", "packed").mapInPandas(_words, "block string, at int, word string")
    # a block holds a word once: a frequent word has a row for each block, and some hundred blocks' share a task
    spread = F.floor(F.pmod(F.xxhash64("block"), F.lit(1 << 20)) * F.lit(max(1, n_blocks // 256)) / F.lit(1 << 20))
    ids = words.repartition("word", spread).sortWithinPartitions("word")
    ids = written(ids.mapInPandas(_encode_words(path, pattern), "block string, n int, packed binary"), "bpe-ids", "none")
    drop(blocks, part="kind=words")
    digest, full = _assemble(path, pattern)
    places = blocks.where("kind = 'places'").select("block", "n", "at", "keys", "sizes", "packed")
    pair = places.groupBy("block").cogroup(ids.groupBy("block"))
    if whole:
        out = pair.applyInPandas(full, "key string, ids array<int>, decoded string")
    else:
        out = pair.applyInPandas(digest, "key string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    own = F.col("key").cast("long")
    return out.withColumn("key", own if nulls is None else F.coalesce(own, F.lit(nulls).cast("long"))).withColumnRenamed("key", "doc_id")


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", nulls: int | None = -1) -> DataFrame:
    """One row per text: ``doc_id, ids array<int>, decoded``.

    Null texts count as empty: no ids, empty decoded text.  A null key comes back as ``nulls`` (None: as
    null).  Repeated rows come back as often as they are there.  Other columns are not looked at.
    """
    return _encoded(docs, key, text, path, pattern, True, nulls)


def encode_digest(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", nulls: int | None = -1) -> DataFrame:
    """As :func:`encode`, with ``n_tokens`` and the SHA-256 of ids and decoded bytes in their place."""
    return _encoded(docs, key, text, path, pattern, False, nulls)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (string) to a table with a column of ids, by the token-byte table.

    Null ids give null; bytes that are no UTF-8 become U+FFFD.  Ids outside the table raise.
    """

    @F.pandas_udf("string")
    def text(col: pd.Series) -> pd.Series:
        _, flat, start, lens = _tables(path, pattern)
        return pd.Series([None if x is None else _gather(flat, start[np.asarray(x, np.int64)], lens[np.asarray(x, np.int64)]).tobytes().decode("utf-8", "replace") for x in col])

    return encoded.withColumn("decoded", text(F.col(ids)))
