"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is a list of symbols, at first its characters. Every adjacent pair that
forms a piece waits in an agenda ordered by the piece's score, then by place;
the best pair is merged, its new neighbours enter the agenda, and pairs whose
symbols have changed are passed over. Symbols that are no piece become bytes.

No piece of such a vocabulary continues past a space mark after other
characters, so texts are cut there and equal parts are encoded once per
worker, up to a bounded number of remembered parts. In every Arrow batch the
parts met for the first time are compared with the sentencepiece library, and
a difference stops the job.

Defined results: a null text counts as empty and has the end id alone;
repeated rows give equal results; an empty table gives no rows. A column of
the input called like a new one is replaced, all others are carried.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T

MARK = "▁"  # stands for a space inside pieces
REMEMBERED_PARTS = 600_000
REMEMBERED_LENGTH = 48
ROWS = 256
_PROBE = "①Ａ é 　x  y​z  \tq"


class PieceModel:
    """The pieces of a merge-type model, with an encoder and a decoder of its own."""

    def __init__(self, proto: bytes) -> None:
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = lib.get_piece_size()
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(size)]
        names = [lib.id_to_piece(i) for i in range(size)]
        self.ids = {names[i]: i for i in range(size) if not special[i]}
        self.scores = {names[i]: lib.get_score(i) for i in range(size) if not special[i]}
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if lib.is_byte(i)}
        self.unknown, self.end = lib.unk_id(), lib.eos_id()
        # What an id stands for; bytes that need neighbours to make a character are kept as escapes.
        self.surface = ["" if special[i] else names[i].replace(MARK, " ") for i in range(size)]
        for b, i in self.bytes.items():
            self.surface[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        self.surface[self.unknown] = " ⁇ "
        self.plain = lib.normalize(_PROBE) == MARK + _PROBE.replace(" ", MARK)
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in joined)
        # Letters for this purpose: what the pattern class takes for one, without numbers like a raised two.
        numbers = re.escape("".join(sorted({c for p in self.ids for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()})))
        letter = rf"[^\W\d_{numbers}]"
        kinds = [{bool(re.match(letter, c)) for c in p.lstrip(MARK)} for p in self.ids]
        cut, out = f"[{re.escape(alone)}]" if alone else r"(?!)", MARK + re.escape(alone)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            self.parts = re.compile(r".+", re.DOTALL)
        elif all(len(k) < 2 for k in kinds):  # no piece joins a letter with anything else
            self.parts = re.compile(rf"{MARK}*(?:{letter}+|(?:(?!{letter})[^{out}])+)|{MARK}+|{cut}")
        else:
            self.parts = re.compile(f"{MARK}*[^{out}]+|{MARK}+|{cut}")
        self.known: dict[str, bytes] = {}
        self.marked = frozenset(i for p, i in self.ids.items() if p[0] == MARK)

    def normalized(self, text: str) -> str:
        if not self.plain:
            return self.library.normalize(text)
        return MARK + text.replace(" ", MARK) if text else ""

    def merge(self, part: str) -> list[str]:
        """The symbols left when no adjacent pair forms a piece."""
        symbols: list[str] = list(part)
        n, scores = len(symbols), self.scores
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                agenda.append((-scores[pair], i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != len(pair):
                continue  # one of the two was merged elsewhere
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                wider = pair + symbols[k]
                if wider in scores:
                    heapq.heappush(agenda, (-scores[wider], i, k, wider))
            h = before[i]
            if h >= 0:
                wider = symbols[h] + pair
                if wider in scores:
                    heapq.heappush(agenda, (-scores[wider], h, i, wider))
        return [s for s in symbols if s]

    def encode_part(self, part: str) -> list[int]:
        out: list[int] = []
        for s in self.merge(part):
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def encode(self, texts: list[str], check: bool = True) -> list[np.ndarray]:
        """The ids of each text with the end id."""
        known, end, fresh, out = self.known, np.int32(self.end).tobytes(), {}, []
        for text in texts:
            parts = self.parts.findall(self.normalized(text))
            got = list(map(known.get, parts))
            if None in got:
                for k, part in enumerate(parts):
                    if got[k] is None:
                        made = known.get(part) or fresh.get(part)
                        if made is None:
                            made = np.asarray(self.encode_part(part), np.int32).tobytes()
                            fresh[part] = made
                            if len(part) <= REMEMBERED_LENGTH:
                                if len(known) >= REMEMBERED_PARTS:
                                    known.clear()
                                known[part] = made
                        got[k] = made
            got.append(end)
            out.append(np.frombuffer(b"".join(got), np.int32))
        if check and self.plain:
            self._compare(fresh)
        return out

    def _compare(self, fresh: dict[str, bytes]) -> None:
        """Stops where the library encodes a part otherwise. It puts a space mark before a text; a part without one follows a line end."""
        parts = [p for p in fresh if p != "\n"]
        asked = [p[1:].replace(MARK, " ") if p[0] == MARK else "\n" + p for p in parts]
        lead = len(self.library.encode("\n"))
        for p, text, ids in zip(parts, asked, self.library.encode(asked), strict=True):
            if p == MARK:
                continue  # the library has no text for a lone mark
            own = np.frombuffer(fresh[p], np.int32).tolist()
            if (ids if text[:1] != "\n" or p[0] == MARK else ids[lead:]) != own:
                raise ValueError(f"the library encodes {p!r} as {ids}, the agenda as {own}")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces put together, bytes read as UTF-8, the mark put before the text taken off."""
        text = "".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.surface[i]), None)
        if first is not None and first in self.marked:
            text = text[1:]
        try:
            text.encode()
        except UnicodeEncodeError:
            raw, out, i = text.encode("utf-8", "surrogateescape"), [], 0
            while i < len(raw):
                try:
                    out.append(raw[i:].decode())
                    break
                except UnicodeDecodeError as e:
                    out += [raw[i : i + e.start].decode(), "�"]
                    i += e.start + 1
            text = "".join(out)
        return text


_MODELS: dict[int, PieceModel] = {}


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", check: bool = True) -> DataFrame:
    """The input rows with ids (array of int, the end id last), n_tokens and decoded.

    The model file is read by the driver and sent with the tasks; a vocabulary file has a size of its own, which
    does not grow with the data.
    """
    with open(model_path, "rb") as file:
        proto = file.read()
    shared, name = docs.sparkSession.sparkContext.broadcast(proto), hash(proto)
    added = ("ids", "n_tokens", "decoded")
    carried = [c for c in docs.columns if c not in added]
    packed = docs.select(F.struct(*carried).alias("row"), F.col(text).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = PieceModel(shared.value)
        model = _MODELS[name]
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                made = model.encode([t or "" for t in part.column(1).to_pylist()], check)
                counts = np.array([len(m) for m in made], np.int64)
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made) if made else np.zeros(0, np.int32)))
                decoded = [model.decode(m.tolist()) for m in made]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), ids, pa.array(counts), pa.array(decoded, pa.string())], names=["row", "ids", "n_tokens", "decoded"]
                )

    schema = T.StructType().add("row", packed.schema["row"].dataType).add("ids", T.ArrayType(T.IntegerType()))
    out = packed.mapInArrow(run, schema.add("n_tokens", "long").add("decoded", "string"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in carried], *added)
