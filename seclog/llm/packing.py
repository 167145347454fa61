"""Packing token pieces into sequences: bounded-space online best-fit over a bitset of free space."""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seclog.llm.common import map_rows, schema_of
from seclog.session import materialize

TOKENIZER = "byte_bpe_50k.tiktoken"
END_ID = 2
CAPACITY = 1024
#: Open sequences of one packing task, and rows it is given on average.
OPEN_BINS = 128
ROWS_PER_TASK = 25_000
#: Known pieces of text a worker keeps, and their greatest length.
KNOWN_CHUNKS, CHUNK_CHARS = 1_000_000, 48

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SAFE_CUT = re.compile(r"(?<=[!-~])(?= [!-~])")


class ChunkIds(dict):
    """Chunk of text -> its token ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self.encode(chunk)).tobytes()
        if len(chunk) <= CHUNK_CHARS:
            if len(self) >= KNOWN_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


def tokenizer_file(name: str) -> str:
    """A path as it is; a bare file name is one of the public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def text_encoder(name: str):
    """text -> ids, a word at a time: byte-level BPE never joins over a single space, which always
    begins a new word, so texts are cut there and the ids of known words are reused. Runs of
    spaces and a space at the end belong together with their neighbours; such texts are cut only
    where a space stands between two visible ASCII characters.

    The file holds the vocabulary as ranks; strings of added tokens are ordinary text here, see
    ``document_encoder``.
    """
    import public_tokenizers
    import tiktoken

    with open(tokenizer_file(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokenizer = tiktoken.Encoding(
        Path(name).stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = ChunkIds(tokenizer.encode_ordinary)
    after_space = ChunkIds(lambda word: tokenizer.encode_ordinary(" " + word))

    def encode(text: str) -> bytes:
        if "  " in text or text.endswith(" "):
            return b"".join(map(whole.__getitem__, _SAFE_CUT.split(text)))
        first, *rest = text.split(" ")
        return whole[first] + b"".join(map(after_space.__getitem__, rest))

    return encode


def added_tokens(name: str) -> dict[str, int]:
    """Content -> id of the tokens that the JSON form beside a rank file adds to its vocabulary."""
    form = Path(tokenizer_file(name)).with_suffix(".json")
    found = json.loads(form.read_text("utf-8")).get("added_tokens", []) if form.exists() else []
    for token in found:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"added token {token['content']!r} takes more or less than its content")
    return {token["content"]: token["id"] for token in found}


def document_encoder(name: str):
    """text -> ids as the JSON form's own library gives them: texts are cut at the contents of added
    tokens, the longest first, and what lies between is encoded by ``text_encoder``."""
    encode = text_encoder(name)
    added = {content: array("I", [n]).tobytes() for content, n in added_tokens(name).items()}
    if not added:
        return encode
    at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode_all(text: str) -> bytes:
        if not at_added.search(text):
            return encode(text)
        parts = at_added.split(text)
        return b"".join(added[part] if n % 2 else encode(part) for n, part in enumerate(parts) if part)

    return encode_all


_ENCODERS: dict[str, object] = {}  # a worker's, over its tasks


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``.

    A text's ids end with id 2; NULL and empty texts are that id alone. A document longer than
    ``capacity`` is cut into pieces of ``capacity``, the first of which is shorter. Repeated rows
    and NULL ids are documents like others; columns other than doc_id and text are not read.
    """
    end = array("I", [END_ID]).tobytes()

    def make():
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = document_encoder(tokenizer)
        encode = _ENCODERS[tokenizer]

        def work(columns):
            for doc_id, text in zip(*columns):
                ids = memoryview((encode(text) if text else b"") + end)
                n, start = len(ids) // 4, 0
                for piece in range(-(-n // capacity)):
                    stop = start + capacity if piece else (n - 1) % capacity + 1
                    yield doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start:4 * stop])
                    start = stop

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, PIECES)


class BestFit:
    """At most ``open_bins`` open bins; a bit of ``bits`` says that some bin has that much room."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.opened = self.open = 0

    def _take(self, at_least: int) -> tuple[int, int]:
        """The bin with the least room that is enough."""
        fitting = self.bits >> at_least
        room = at_least + (fitting & -fitting).bit_length() - 1
        bins = self.by_room[room]
        taken = bins.pop()
        if not bins:
            self.bits ^= 1 << room
        return taken, room

    def place(self, length: int) -> tuple[int, int]:
        """(bin, place in it) of a piece."""
        if self.bits >> length:
            at, room = self._take(length)
        else:
            if self.open == self.open_bins:
                self._take(0)  # the fullest closes
                self.open -= 1
            at, room = self.opened, self.capacity
            self.opened += 1
            self.open += 1
        left = room - length
        if left:
            self.by_room[left].append(at)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return at, self.capacity - room


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset``; sequences are gapless from 0 and hold ``capacity`` at most.

    Pieces are computed once and kept in the shared folder. Full ones are sequences of their own
    where they lie; only the lengths of the others move, dealt evenly whatever their keys. Each
    task takes its pieces as they come and keeps at most ``open_bins`` bins open: one more, and the fullest
    closes. An empty input gives no rows.
    """
    kept = materialize(pieces)
    alone = kept.where(F.col("length") >= capacity).select(
        "*", (F.monotonically_increasing_id() * 2).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    shorter = kept.where(F.col("length") < capacity)
    tasks = max(1, -(-shorter.count() // rows_per_task))
    ddl = f"{PIECES}, sequence_id long, offset long"

    def make():
        from pyspark import TaskContext

        bins, first = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 33

        def work(columns):
            for row in zip(*columns):
                at, offset = bins.place(row[3])
                yield *row, 2 * (first + at) + 1, offset

        return work

    packed = map_rows(shorter.repartition(tasks), make, ddl)
    return alone.select(*schema_of(ddl).fieldNames()).unionByName(packed)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, **options) -> DataFrame:
    """Texts as token pieces in sequences; see ``token_pieces`` and ``pack``."""
    capacity = options.get("capacity", CAPACITY)
    return pack(token_pieces(docs, tokenizer, capacity), **options)


