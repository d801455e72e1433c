"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of whole documents in a row, cut into blocks of BLOCK ids. A block subtracts its minimum and packs the
differences at the bit width that PERCENTILE of them need; the rest, the outliers, stand in the block's exception list. An
index of block starts lets a reader decode any stretch of ids alone. Layout, little-endian:

    MAGIC
    block*       minimum u32, width u8, 0 u8, exceptions u16, packed (BLOCK * width / 8 bytes), (place u16, difference u32)*
    index        u64 for each block start and for the end of the last
    documents    doc_id i64 each, null flag u8 each, ids u32 each
    footer       JSON with counts and places, then its length u32, then MAGIC

write_tokens() deals documents out by ranges of doc_id, so the files in order of their number and part hold ascending ids;
each task streams its range through the tokenizer into files of its own, the next one from FILE_TOKENS ids on. The table of files is committed by Spark, and a reader opens
only files in that table: a task that ran twice leaves an unlisted file at worst.

Defined cases: a null or empty text is encoded as the end id alone; null doc_ids come first; rows with the same doc_id are
documents of their own; an empty table gives no files; further columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.shared import bound_batches, materialise, read_bytes, releasing, scratch, writing

MAGIC = b"QMTOKEN1"
BLOCK = 256
PERCENTILE = 0.9
_LANES = 64  # values that are packed together, into `width` words of 64 bits

# --- blocks ---------------------------------------------------------------------------------------------------------


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, BLOCK) differences below 2 ** width to (rows, bytes)."""
    if not width:
        return np.zeros((len(values), 0), np.uint8)
    lanes = np.ascontiguousarray(values.reshape(-1, _LANES).T.astype(np.uint64))
    out = np.zeros((width, lanes.shape[1]), np.uint64)
    for k in range(_LANES):
        word, bit = divmod(k * width, 64)
        out[word] |= lanes[k] << np.uint64(bit)
        if bit + width > 64:
            out[word + 1] |= lanes[k] >> np.uint64(64 - bit)
    return np.ascontiguousarray(out.T).view(np.uint8).reshape(len(values), -1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """The inverse of _pack: (rows, bytes) to (rows, BLOCK)."""
    if not width:
        return np.zeros((len(packed), BLOCK), np.uint32)
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view(np.uint64).reshape(-1, width).T)
    out = np.empty((_LANES, words.shape[1]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(_LANES):
        word, bit = divmod(k * width, 64)
        value = words[word] >> np.uint64(bit)
        if bit + width > 64:
            value = value | (words[word + 1] << np.uint64(64 - bit))
        out[k] = value & mask
    return np.ascontiguousarray(out.T).reshape(len(packed), BLOCK)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of a multiple of BLOCK ids."""
    rows = ids.astype(np.uint32).reshape(-1, BLOCK)
    low = rows.min(axis=1)
    over = rows - low[:, None]
    at = min(BLOCK - 1, int(PERCENTILE * BLOCK))
    need = np.partition(over, at, axis=1)[:, at].astype(np.float64)
    widths = np.ceil(np.log2(need + 1)).astype(np.int64)
    blocks: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths):
        mine = np.flatnonzero(widths == width)
        part = over[mine]
        out = part >= np.uint32(1 << int(width)) if width < 32 else np.zeros(part.shape, bool)
        packed = _pack(np.where(out, 0, part), int(width))
        row, place = np.nonzero(out)
        listed = np.empty(len(row), np.dtype([("place", "<u2"), ("over", "<u4")]))
        listed["place"], listed["over"] = place, part[row, place]
        starts = np.searchsorted(row, np.arange(len(mine) + 1))
        for i, b in enumerate(mine):
            some = listed[starts[i] : starts[i + 1]]
            blocks[b] = struct.pack("<IBBH", int(low[b]), int(width), 0, len(some)) + packed[i].tobytes() + some.tobytes()
    return blocks


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start at these places of data."""
    raw = np.frombuffer(data, np.uint8)
    head = raw[starts[:, None] + np.arange(8)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    widths, listed = head[:, 4].astype(np.int64), np.ascontiguousarray(head[:, 6:8]).view("<u2")[:, 0].astype(np.int64)
    over = np.empty((len(starts), BLOCK), np.uint32)
    for width in np.unique(widths):
        mine = np.flatnonzero(widths == width)
        size = BLOCK * int(width) // 8
        over[mine] = _unpack(raw[starts[mine][:, None] + 8 + np.arange(size)], int(width))
    for b in np.flatnonzero(listed):
        at = int(starts[b]) + 8 + BLOCK * int(widths[b]) // 8
        some = np.frombuffer(data, np.dtype([("place", "<u2"), ("over", "<u4")]), int(listed[b]), at)
        over[b, some["place"]] = some["over"]
    return (over + low[:, None]).reshape(-1)


class Writer:
    """Writes documents to one file; holds one stretch of ids and the index."""

    def __init__(self, out, chunk_blocks: int = 2048):
        self.out, self.chunk = out, chunk_blocks * BLOCK
        self.rest: list[np.ndarray] = []
        self.held = self.n_tokens = 0
        self.at, self.index = len(MAGIC), [len(MAGIC)]
        self.docs: list[tuple[int, int, int]] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.rest.append(ids)
        self.held += len(ids)
        self.n_tokens += len(ids)
        if self.held >= self.chunk:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.rest)
        blocks = encode_blocks(ids[:n])
        self.index.extend((self.at + np.cumsum([len(b) for b in blocks])).tolist())
        self.at = self.index[-1]
        self.out.write(b"".join(blocks))
        self.rest, self.held = [ids[n:]], len(ids) - n

    def close(self) -> dict:
        if self.held:
            short = -self.held % BLOCK
            self.rest.append(np.repeat(np.concatenate(self.rest)[-1:], short))
            self.held += short
            self._flush(self.held)
        index = np.array(self.index, "<u8").tobytes()
        ids, nulls, lengths = np.array(self.docs, np.int64).reshape(-1, 3).T
        docs = ids.astype("<i8").tobytes() + nulls.astype(np.uint8).tobytes() + lengths.astype("<u4").tobytes()
        footer = {"n_tokens": self.n_tokens, "n_docs": len(self.docs), "n_blocks": len(self.index) - 1, "block": BLOCK, "index_at": self.at, "docs_at": self.at + len(index)}
        text = json.dumps(footer).encode()
        self.out.write(index + docs + text + struct.pack("<I", len(text)) + MAGIC)
        return footer | {"n_bytes": footer["docs_at"] + len(docs) + len(text) + 4 + len(MAGIC)}


class Reader:
    """Reads any stretch of ids, or the documents one after the other."""

    def __init__(self, uri: str, n_bytes: int):
        self.uri = uri
        tail = read_bytes(uri, max(0, n_bytes - 4096), 4096)
        assert tail[-len(MAGIC) :] == MAGIC, f"{uri} is not a token file"
        size = struct.unpack("<I", tail[-len(MAGIC) - 4 : -len(MAGIC)])[0]
        f = self.footer = json.loads(tail[-len(MAGIC) - 4 - size : -len(MAGIC) - 4])
        data = read_bytes(uri, f["index_at"], n_bytes - f["index_at"])
        n = f["n_docs"]
        self.index = np.frombuffer(data, "<u8", f["n_blocks"] + 1).astype(np.int64)
        at = f["docs_at"] - f["index_at"]
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.nulls = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.lengths = np.frombuffer(data, "<u4", n, at + 9 * n).astype(np.int64)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        at = int(self.index[first])
        data = read_bytes(self.uri, at, int(self.index[last]) - at)
        return decode_blocks(data, self.index[first:last] - at)[start - first * BLOCK : stop - first * BLOCK]

    def documents(self, stretch: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of its first id in the file, ids); decodes about `stretch` ids at a time."""
        ends = np.cumsum(self.lengths)
        k = 0
        while k < len(ends):
            start = int(ends[k] - self.lengths[k])
            stop = max(k + 1, int(np.searchsorted(ends, start + stretch, "right")))
            ids = self.tokens(start, int(ends[stop - 1]))
            for i in range(k, stop):
                at = int(ends[i] - self.lengths[i])
                yield None if self.nulls[i] else int(self.doc_ids[i]), at, ids[at - start : at - start + int(self.lengths[i])]
            k = stop


# --- encoding -------------------------------------------------------------------------------------------------------


#: White space by Unicode; a space between two of these may not be cut at.
_SPACES = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_WIDE = f"[{_SPACES}] [{_SPACES}]"
#: Pieces that may stand in one text after line feeds: no white space at either end, but for a space in front of something else.
_JOINS = f"(?s)^ ?[^{_SPACES}](?:.*[^{_SPACES}])?$"
#: Pieces within which GPT-2's expression cuts nowhere.
_SINGLE = r"^ ?(?:[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)$"

_OTHER, _LETTER, _DIGIT, _SIGN, _APOSTROPHE, _SPACE, _FEED = range(7)


def _kinds() -> np.ndarray:
    """Kind of each byte; those beyond ASCII are _OTHER, and so are the rarer kinds of white space and control characters."""
    kinds = np.full(256, _OTHER, np.uint8)
    for b in range(0x21, 0x7F):
        kinds[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SIGN
    kinds[ord("'")], kinds[ord(" ")], kinds[ord("\n")] = _APOSTROPHE, _SPACE, _FEED
    return kinds


def _cuts() -> np.ndarray:
    """Whether there is a cut between two kinds (8 * first + second), whatever stands around them."""
    cuts = np.zeros((8, 8), bool)
    cuts[:, _SPACE] = True  # not in texts with _WIDE
    known = (_LETTER, _DIGIT, _SIGN, _APOSTROPHE)
    for a in known:
        cuts[a, _FEED] = True
        for b in known:
            cuts[a, b] = a != b and {a, b} != {_SIGN, _APOSTROPHE} and (a, b) != (_APOSTROPHE, _LETTER)
    return cuts.reshape(-1)


def _alphabet() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be seen, else one from U+0100 on."""
    seen = np.zeros(256, bool)
    seen[0x21:0x7F] = seen[0xA1:0xAD] = seen[0xAE:] = True
    return np.where(seen, np.arange(256), 255 + np.cumsum(~seen)).astype("<u4")


_KINDS, _CUTS, _ALPHABET = _kinds(), _cuts(), _alphabet()
_FEED_SPELLED = chr(_ALPHABET[ord("\n")])
#: A stretch is remembered in one of 2 ** SLOTS places, by a sum of its bytes with these weights.
SLOTS = 21
_WEIGHTS = np.random.default_rng(11).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _slots(stretches: pa.Array) -> np.ndarray:
    """The place of each stretch; none is empty."""
    offsets = np.frombuffer(stretches.buffers()[1], np.int32, len(stretches) + 1, 4 * stretches.offset)
    raw = np.frombuffer(stretches.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    place = np.arange(len(raw), dtype=np.int32) - np.repeat(starts, np.diff(offsets))
    return (np.add.reduceat(raw * _WEIGHTS[place & 63], starts) >> np.uint64(64 - SLOTS)).astype(np.int64)


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts cut into pieces, and the place of each text's first piece and of the end. Pieces are slices of the texts' own bytes."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    data = texts.buffers()[2] or pa.py_buffer(b"")
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    kinds = _KINDS[raw]
    # U+00C0 to U+00FF, letters but for the signs of multiplication and division
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] & 0xDF) != 0x97]
    kinds[lead] = kinds[lead + 1] = _LETTER
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:-1] = _CUTS[(kinds[:-1] << 3) | kinds[1:]]
    # a line feed alone between two others that are no white space
    feed = np.flatnonzero(kinds[1:-1] == _FEED)
    known = (kinds >= _LETTER) & (kinds <= _APOSTROPHE)
    cut[feed[known[feed] & known[feed + 2]] + 2] = True
    starts = offsets - offsets[0]
    cut[starts] = True
    bounds = np.flatnonzero(cut).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds + offsets[0]), data)
    return pieces, np.searchsorted(bounds, starts)


class Encoder:
    """Encodes texts; what came before is not encoded again.

    A byte-level vocabulary cuts a text into pieces by the expression of GPT-2 and encodes them one by one. Of its cuts those are
    used that two bytes show by themselves: before a space, unless white space stands on both sides of it; between letters,
    digits and other signs of ASCII and Latin-1, but not after an apostrophe; and around a line feed that stands alone. Each
    new stretch between two of them goes through the tokenizer once, and ids are put together by number. Texts with such
    spaces and those that hold an added token of the vocabulary go through it whole, and so do all texts if the tokenizer
    cuts by anything else. Stretches without a cut within go to its model alone, in the alphabet of its vocabulary. Up to MOST
    stretches are remembered, as one string array that a table of places leads to; later ones, and those whose place is
    taken, only for the group of texts that they stand in.
    """

    MOST = 500_000
    JOINED = 1024  # stretches that go through the tokenizer as one text

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        made = json.loads(self.whole.to_str())
        cutter, model = made["pre_tokenizer"] or {}, made["model"]
        self.cuts = (
            (cutter.get("type"), cutter.get("add_prefix_space"), cutter.get("use_regex", True)) == ("ByteLevel", False, True)
            and model.get("type") == "BPE"
            and not any(made.get(k) for k in ("normalizer", "truncation", "padding"))
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        )
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # in this alphabet a character stands for a byte
        self.n_bytes = np.array([len(self.whole.id_to_token(i) or "") for i in range(self.whole.get_vocab_size())], np.int64)
        self.known, self.ids = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)  # of the ids of each known stretch, after a 0
        self.places = np.full(1 << SLOTS, -1, np.int32)  # number of the known stretch in each place

    @staticmethod
    @functools.cache
    def shared(path: str) -> Encoder:
        """One for each worker process, for all its tasks; what it remembers does not change results."""
        return Encoder(path)

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _counts(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """How many ids stand for each of these numbers of bytes in a row."""
        return np.diff(np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(sizes), "left") + 1, prepend=0)

    def _single(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches (_SINGLE) one after the other, and the number of ids of each."""
        text = "\n".join(new.to_pylist()).encode()
        spelled = _ALPHABET[np.frombuffer(text, np.uint8)].tobytes().decode("utf-32-le").replace(_FEED_SPELLED, "\n")
        ids = np.array(self.model.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, np.uint32)
        return ids, self._counts(ids, pc.binary_length(new).to_numpy())

    def _joined(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of stretches (_JOINS). They go through the tokenizer as one text, each after a line feed, and are told
        apart by the bytes that their ids stand for."""
        ids = np.array(self._each(["\n" + "\n".join(new.to_pylist())])[0], np.uint32)
        counts = self._counts(ids, 1 + pc.binary_length(new).to_numpy())
        return np.delete(ids, np.cumsum(counts) - counts), counts - 1

    def _alone(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of any stretches."""
        each = self._each(new.to_pylist())
        return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64)

    def _learned(self, found: pa.Array, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The missing ones of the stretches found, in the order that they are learned in, their ids and the number of ids of each."""
        new = found.take(pa.array(missing))
        single = pc.match_substring_regex(new, _SINGLE).to_numpy(zero_copy_only=False)
        joins = ~single & pc.match_substring_regex(new, _JOINS).to_numpy(zero_copy_only=False)
        order, parts = [], []
        for mine, learn in ((single, self._single), (joins, self._joined), (~single & ~joins, self._alone)):
            some = missing[mine]
            for at in range(0, len(some), self.JOINED):
                order.append(some[at : at + self.JOINED])
                parts.append(learn(found.take(pa.array(order[-1]))))
        return np.concatenate(order), np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _numbered(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each piece, and the ids and the ends of the ids, after a 0, of all numbers."""
        coded = pieces.dictionary_encode()
        found = coded.dictionary
        slots = _slots(found)
        of = self.places[slots].astype(np.int64)
        there = np.flatnonzero(of >= 0)
        same = pc.equal(self.known.take(pa.array(of[there])), found.take(pa.array(there))).to_numpy(zero_copy_only=False)
        of[there[~same]] = -1
        ids, ends = self.ids, self.ends
        missing = np.flatnonzero(of < 0)
        if len(missing):
            missing, more, lengths = self._learned(found, missing)
            of[missing] = len(self.known) + np.arange(len(missing))
            ids, ends = np.concatenate([ids, more]), np.concatenate([ends, ends[-1] + np.cumsum(lengths)])
            kept = missing[: max(0, self.MOST - len(self.known))]
            if len(kept):
                self.known = pa.concat_arrays([self.known, found.take(pa.array(kept))])
                self.ends = ends[: len(self.known) + 1].copy()
                self.ids = ids[: self.ends[-1]].copy()
                kept = kept[self.places[slots[kept]] < 0]
                self.places[slots[kept]] = of[kept]
        return of[coded.indices.to_numpy()], ids, ends

    def encode(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """Ids of each text (a string array without nulls), with the end id."""
        texts = texts.cast(pa.string())
        odd = pa.array(np.full(len(texts), not self.cuts))
        if self.cuts:
            odd = pc.match_substring_regex(texts, _WIDE)
            for token in self.added:
                odd = pc.or_(odd, pc.match_substring(texts, token))
        odd = odd.to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.array([end], np.uint32)] * len(texts)
        whole = np.flatnonzero(odd)
        for i, ids in zip(whole, self._each(texts.take(pa.array(whole)).to_pylist()), strict=True):
            out[i] = np.append(np.array(ids, np.uint32), np.uint32(end))
        plain = np.flatnonzero(~odd)
        if not len(plain):
            return out
        pieces, begin = _pieces(texts.take(pa.array(plain)) if len(whole) else texts)
        if not len(pieces):
            return out
        numbers, ids, ends = self._numbered(pieces)
        lengths = np.diff(ends)[numbers]
        stops = np.cumsum(lengths)
        spelled = ids[np.repeat(ends[numbers] - stops + lengths, lengths) + np.arange(int(stops[-1]))]
        bounds = np.concatenate([[0], stops])[begin]
        for i, a, b in zip(plain.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = np.append(spelled[a:b], np.uint32(end))
        return out


_FILES = "number int, part int, uri string, n_bytes long, n_docs long, n_tokens long, n_blocks long"
_FILE_KIND = pa.schema([("number", pa.int32()), ("part", pa.int32()), ("uri", pa.string()), *((k, pa.int64()) for k in ("n_bytes", "n_docs", "n_tokens", "n_blocks"))])
#: A task goes on with a new file from so many ids on; texts are encoded in groups of about so many bytes.
FILE_TOKENS = 1 << 26
GROUP = 2 << 20


def _groups(batch: pa.RecordBatch, group: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about this many bytes of text (column 1), of a document at least."""
    text = batch.column(1)
    ends = np.cumsum(pc.binary_length(text).to_numpy().astype(np.int64))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + group, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def write_tokens(docs: DataFrame, tokenizer: str, end: int, doc_id: str = "doc_id", text: str = "text", file_tokens: int = FILE_TOKENS, group: int = GROUP) -> DataFrame:
    """Writes the ids of all documents and returns the table of files: _FILES and start, the ids in the files before."""
    bound_batches(docs.sparkSession)
    folder = scratch(docs.sparkSession, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        encoder = Encoder.shared(tokenizer)
        groups = (g for b in batches for g in _groups(b, group))
        held = next(groups, None)
        part = 0
        while held is not None:
            uri = f"{folder}/{number:06d}-{part:04d}-{uuid.uuid4().hex}.tok"
            with writing(uri) as out:
                writer = Writer(out)
                while held is not None and writer.n_tokens < file_tokens:
                    for d, ids in zip(held.column(0).to_pylist(), encoder.encode(held.column(1), end), strict=True):
                        writer.add(d, ids)
                    held = next(groups, None)
                done = writer.close()
            yield pa.RecordBatch.from_pylist([{"number": number, "part": part, "uri": uri} | {k: done[k] for k in ("n_bytes", "n_docs", "n_tokens", "n_blocks")}], _FILE_KIND)
            part += 1

    files = materialise(rows.repartitionByRange("d").sortWithinPartitions("d").mapInArrow(releasing(write), _FILES), "token-files")
    before = Window.orderBy("number", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"


def read_tokens(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row for each document in the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])]
        for batch in batches:
            for f in batch.to_pylist():
                rows: list[tuple] = []
                weight = 0
                for d, at, ids in Reader(f["uri"], f["n_bytes"]).documents():
                    rows.append((d, f["start"] + at, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), *([ids.astype(np.int32)] if with_ids else [])))
                    weight += 1 + with_ids * len(ids)
                    if weight > 1 << 18:
                        yield _rows(rows, kinds)
                        rows, weight = [], 0
                if rows:
                    yield _rows(rows, kinds)

    schema = _READ if with_ids else _READ.removesuffix(", ids array<int>")
    n = max(1, files.sparkSession.sparkContext.defaultParallelism)
    return files.select("uri", "n_bytes", "start").repartition(4 * n).mapInArrow(releasing(read), schema)


def _rows(rows: list[tuple], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])
