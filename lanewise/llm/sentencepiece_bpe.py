"""SentencePiece BPE by backtracking, and its decoding.

The piece file is read once per worker. The longest piece at every place of a
chunk comes from one Aho-Corasick pass. Tokens are taken greedily; a token may
follow another if merging the two texts anew ends in just these two tokens.
Where no piece fits, the last token is undone, its place marked in a bitfield
so that it is never tried again, and a shorter piece is tried. The first
complete sequence is the result of the merges, as adjacent pairs decide it.

Where no piece has the blank sign after another character, merges never cross
such a place; the text is cut there and the chunks are remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from lanewise.llm.common import release_memory, small_batches, worker_cache

BLANK = "▁"
_REMEMBERED = 600_000
_REMEMBERED_LENGTH = 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            length = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + length]
            at += length


def _settings(path: str) -> dict[str, int]:
    """Model kind and text normalising, which have to be the kind built here."""
    with open(path, "rb") as file:
        message = list(_fields(file.read()))
    trainer = dict(_fields(next(v for k, v in message if k == 2)))
    normal = dict(_fields(next(v for k, v in message if k == 3)))
    out = {
        "bpe": int(trainer.get(3, 1) == 2),
        "fallback": trainer.get(35, 0),
        "suffix": trainer.get(24, 0),
        "identity": int(not normal.get(2)),
        "prefix": normal.get(3, 1),
        "squeeze": normal.get(4, 1),
        "escape": normal.get(5, 1),
    }
    if not (out["bpe"] and out["fallback"] and out["identity"] and out["escape"]) or out["squeeze"] or out["suffix"]:
        raise ValueError("only BPE models with byte fallback and identity normalising are read")
    return out


class Encoder:
    """Encodes and decodes with one piece file."""

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        self.bos, self.eos = model.bos_id(), model.eos_id()
        self.prefix = _settings(path)["prefix"]
        size = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_ids = [0] * 256
        self.rank: dict[str, float] = {}  # smaller merges first
        self.ids: dict[str, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif model.is_unknown(i):
                self.bytes_of[i] = b" \xe2\x81\x87 "
            elif not model.is_control(i):
                self.ids[piece], self.rank[piece] = i, -model.get_score(i)
                self.bytes_of[i] = piece.replace(BLANK, " ").encode()
        self.cut = not any(re.search(f"[^{BLANK}]{BLANK}", piece) for piece in self.ids)
        self.chunks = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.pieces = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) == 1 or self.merged(piece) == [piece]:
                self.pieces.add_word(piece, len(piece))
        self.pieces.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces left when adjacent parts of a text are merged, best rank first, then leftmost."""
        parts: list[str | None] = list(text)
        left = list(range(-1, len(parts) - 1))
        right = [*range(1, len(parts)), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (rank := self.rank.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (rank, i, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = right[i]
            if parts[i] is None or j < 0 or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j], right[i] = whole, None, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def compatible(self, a: str, b: str) -> bool:
        """Whether ``b`` may follow ``a``: merging both texts anew gives the two again."""
        key = (a, b)
        if (good := self.fits.get(key)) is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            good = self.fits[key] = self.merged(a + b) == [a, b]
        return good

    def backtrack(self, text: str) -> list[str]:
        """The merged pieces of a text, by longest matches and backtracking."""
        longest = [1] * len(text)
        for end, length in self.pieces.iter(text):
            if length > longest[end - length + 1]:
                longest[end - length + 1] = length
        failed = bytearray(len(text) // 8 + 1)  # places from which no sequence reaches the end
        taken: list[str] = []
        at, length = 0, longest[0]
        while True:
            while length:
                piece, after = text[at : at + length], at + length
                if (
                    not failed[after >> 3] >> (after & 7) & 1
                    and (length == 1 or piece in self.pieces)
                    and (not taken or self.compatible(taken[-1], piece))
                ):
                    break
                length -= 1
            if length:
                taken.append(piece)
                at = after
                if at == len(text):
                    return taken
                length = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not taken:
                    raise ValueError("no sequence of pieces is the result of the merges")
                length = len(taken.pop())
                at -= length
                length -= 1

    def _chunk(self, chunk: str) -> bytes:
        # Runs of blanks are merges of equal rank, whose order no pair of neighbours tells.
        pieces = self.merged(chunk) if chunk.startswith(BLANK * 2) else self.backtrack(chunk)
        ids: list[int] = []
        for p in pieces:
            known = self.ids.get(p)
            ids.extend([known] if known is not None else [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")])
        found = np.array(ids, "<u4").tobytes()
        if len(chunk) <= _REMEMBERED_LENGTH:
            if len(self.known) > _REMEMBERED:
                self.known.clear()
            self.known[chunk] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids with begin and end."""
        out = [np.array([self.bos], "<u4").tobytes()]
        if text:
            text = (" " * self.prefix + text).replace(" ", BLANK)
            known, chunk = self.known, self._chunk
            for c in self.chunks.findall(text) if self.cut else [text]:
                out.append(known.get(c) or chunk(c))
        out.append(np.array([self.eos], "<u4").tobytes())
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        if self.prefix and text.startswith(b" "):
            text = text[1:]
        return text.decode("utf-8", "replace")


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded text.

    ``ids`` are those of the sentencepiece library with begin and end and
    without sampling; null and empty texts have just those two. Null ids stay,
    repeated rows give equal rows, further columns are ignored, an empty table
    gives an empty result. ``model_path`` is read on every worker.
    """
    more = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("sentencepiece_bpe")
        if model_path not in cache:
            cache[model_path] = Encoder(model_path)
        coder = cache[model_path]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                counts, digests, decoded, ids, texts = [], [], [], [], []
                for text in batch.column(1).to_pylist():
                    found = coder.encode(text)
                    back = coder.decode(found)
                    counts.append(len(found))
                    digests.append(hashlib.sha256(found.tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        ids.append(found.astype(np.int32))
                        texts.append(back)
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)
        release_memory()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
