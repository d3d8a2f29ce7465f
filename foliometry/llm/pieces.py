"""SentencePiece ids of whole texts through a table of distinct chunks, and the text that they decode to.

No piece of the vocabulary holds a whitespace marker after another character, so no piece, and no
merge, crosses the place where a marker follows one. A text is cut there into marked words; each
distinct one is segmented, and decoded, once for a task's table, and texts get their ids from it by
position. Tables are bounded and live in the task that reads the texts, so nothing is shuffled:
one table of the whole corpus would move every block's distinct words out and their ids back.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textops import slices

#: The whitespace marker, and the chunks that a task's table holds before a new one is begun.
MARKER, TABLE_CHUNKS = "▁", 1 << 19
#: Bytes of text that are looked up together.
PART_BYTES = 1 << 22
SPACE = 32


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(model: str) -> sentencepiece.SentencePieceProcessor:
    """The model; a ValueError if its words cannot be segmented on their own.

    A piece must not hold a marker after another character, and the normalizer must turn spaces
    into markers, put one in front and change nothing else.
    """
    found = sentencepiece.SentencePieceProcessor(model_file=model)
    for i in range(found.vocab_size()):
        if MARKER in found.id_to_piece(i).lstrip(MARKER):
            raise ValueError(f"pieces of {model} cross whitespace markers: {found.id_to_piece(i)!r}")
    for text in ("a  b ", " éﬁ　A\n\tb"):
        if found.normalize(text) != (MARKER + text.replace(" ", MARKER)):
            raise ValueError(f"the normalizer of {model} changes more than spaces")
    return found


class ChunkTable:
    """Ids and decoded bytes of distinct chunks, each worked out when it is first met.

    A chunk's key is what the library must be given to segment the marked word: the word without
    its first marker, which the normalizer puts in front.
    """

    def __init__(self, model: sentencepiece.SentencePieceProcessor, most: int = TABLE_CHUNKS):
        self.model, self.most = model, most
        self.lone = model.piece_to_id(MARKER)
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.begin = array("i"), array("q", [0])  # all chunks' ids, and where each begins
        self.decoded: list[bytes] = []

    def places(self, keys: list[bytes]) -> np.ndarray:
        if len(self.place) + len(keys) > self.most:
            self.clear()
        new = [k for k in keys if k not in self.place]
        if new:
            texts = [k.decode() for k in new]
            ids = self.model.encode(texts, num_threads=1)
            ids = [own or [self.lone] for own in ids]  # the library gives nothing for a text of no character
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.begin.extend(accumulate(map(len, ids), initial=self.begin.pop()))
            self.ids.extend(chain.from_iterable(ids))
            # decoding drops the marker in front of a text, which here stands for a space of it
            self.decoded += [b" " + text.encode() for text in self.model.decode(ids, num_threads=1)]
        return np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))


def clean_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts, markers as spaces; null is empty, bytes that are no UTF-8 are U+FFFD."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    try:
        plain = MARKER not in data.tobytes().decode()
    except UnicodeDecodeError:
        plain = False
    if plain:
        return data, offsets - offsets[0]
    texts = [b.decode(errors="replace").replace(MARKER, " ").encode() for b in column.to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(keys of all chunks in order, first chunk of each text and one more).

    A chunk begins where a text begins, or where a space follows another character; there the space
    is the chunk's first marker and not part of its key, so keys tile what is left.
    """
    space = data == SPACE
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut[filled] = False
    begin = cut.copy()
    begin[filled] = True
    rest = data[~cut]
    at = np.flatnonzero(begin)
    lost = np.concatenate([[0], np.cumsum(cut, dtype=np.int64)])
    bounds = np.append(at - lost[at], len(rest))
    keys = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(rest)])
    return keys, np.searchsorted(at, offsets)


def gathered(table: ChunkTable, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Ids (with the end id) and decoded text of each text, from the table by position."""
    keys, first = chunks(data, offsets)
    coded = keys.dictionary_encode()
    place = table.places(coded.dictionary.to_pylist())
    at = coded.indices.to_numpy().astype(np.int64)
    flat, begin = np.array(table.ids, np.int32), np.array(table.begin, np.int64)
    size = np.diff(begin)[place]
    # every chunk's ids one after the other, and room for the end id after each text
    n = size[at]
    before = np.concatenate([[0], np.cumsum(n)])
    bounds = before[first] + np.arange(len(offsets))
    ids = np.full(int(bounds[-1]), table.model.eos_id(), np.int32)
    source = np.repeat(begin[place[at]] - before[:-1], n) + np.arange(int(n.sum()))
    target = np.ones(len(ids), bool)
    target[bounds[1:] - 1] = False
    ids[target] = flat[source]
    ids = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(ids))
    words = pa.array([table.decoded[p] for p in place], pa.large_binary()).take(coded.indices)
    return ids, joined_texts(words, first)


def joined_texts(words: pa.Array, first: np.ndarray) -> pa.Array:
    """The words from each of ``first`` to the next one as a text without the space in front."""
    if not len(words):
        return pa.array([b""] * (len(first) - 1), pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
    bounds = offsets[first]
    filled = bounds[:-1] < bounds[1:]
    keep = np.ones(int(offsets[-1]), bool)
    keep[bounds[:-1][filled]] = False
    rest = np.frombuffer(words.buffers()[2], np.uint8)[: len(keep)][keep]
    bounds = bounds - np.concatenate([[0], np.cumsum(filled)])
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(rest)])


def encoded(docs: DataFrame, model: str | None = None, most: int = TABLE_CHUNKS) -> DataFrame:
    """doc_id, ids array<int>, decoded string: each whole text's ids with an end id, and what they decode to.

    Equal to the library's own ``encode`` of the whole text, without sampling and without a begin
    id, and to its ``decode``. A null or empty text has the end id alone and decodes to an empty
    text. Bytes that are no UTF-8 count as U+FFFD. Repeated rows and null ids each give a row;
    no rows give none; other columns are ignored. A task holds a batch of texts of some megabytes,
    or one text if it is longer, and a table of ``most`` chunks.
    """
    path = model or public_model()
    load(path)  # an unfit model fails here and not in a task
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(sentencepiece.SentencePieceProcessor(model_file=path), most)
        for batch in batches:
            data, offsets = clean_bytes(batch.column("text"))
            for i, j, part, bounds in slices(data, offsets, PART_BYTES):
                ids, texts = gathered(table, part, bounds)
                columns = [batch.column("doc_id").slice(i, j - i), ids.cast(pa.list_(pa.int32())), texts.cast(pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``encoded``."""
    listed = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
    text = F.sha2(F.col("decoded").cast("binary"), 256)
    n = F.size("ids").cast("long")
    return encoded(docs, model).select("doc_id", n.alias("n_tokens"), listed.alias("ids_sha256"), text.alias("decoded_sha256"))
