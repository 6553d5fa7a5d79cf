"""Encoding and decoding with a merge-type (BPE) SentencePiece model, exactly.

A sequence of pieces is the model's encoding of a text if and only if every two
neighbours are compatible: merging the characters of the two again, best score
first and leftmost on ties, gives just these two. So a text is encoded by
searching from the left: take the longest piece that an Aho-Corasick automaton
finds at the place and that is compatible with the piece before it; where none
is, mark the place as failed in a bitfield, drop the last piece and try its
next shorter one. A place is reached by one sequence only, so a failed one
fails for good and the search is linear.

White space becomes U+2581 and stands only at the head of a piece (checked when
the model is read), so no piece crosses from a word into the next one's U+2581:
the units between such places are encoded one by one and remembered.

A null or empty text has no pieces. Repeated rows stay, extra columns are kept
by ``encode`` as they are; an input column named like a new one is replaced. A
very long text is one row like any other, its ids are held at once. An empty
table gives an empty table.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Bytes of units and their ids that a task remembers, the longest of them, and pairs of pieces.
REMEMBERED_BYTES, REMEMBERED_CHARS, REMEMBERED_PAIRS = 160 << 20, 48, 1 << 19
#: What a remembered unit takes beside its characters and ids.
ENTRY_BYTES = 200

_units = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PieceModel:
    def __init__(self, model: bytes):
        sp = self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        self.end_id = sp.eos_id()
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.text = {i: sp.id_to_piece(i) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.id_of = {x: i for i, x in self.text.items()}
        self.score = {x: sp.get_score(i) for x, i in self.id_of.items()}
        if any(SPACE in x.lstrip(SPACE) for x in self.id_of):
            raise ValueError("a piece holds white space behind other characters")
        if not {c for x in self.id_of for c in x} <= self.id_of.keys() or len(self.byte_id) != 256:
            raise ValueError("a character or byte has no piece of its own")
        if sp.encode("①  A") != sp.encode(f"①{SPACE}{SPACE}A") or sp.decode(sp.encode(" ①  A ")) != " ①  A ":
            raise ValueError("the model changes texts before it encodes them")
        self.find = ahocorasick.Automaton()
        for x, i in self.id_of.items():
            self.find.add_word(x, (i, len(x)))
        self.find.make_automaton()
        self.bytes_of = [b""] * sp.get_piece_size()
        for b, i in self.byte_id.items():
            self.bytes_of[i] = bytes([b])
        for i, x in self.text.items():
            self.bytes_of[i] = x.replace(SPACE, " ").encode()
        self.compatible = lru_cache(REMEMBERED_PAIRS)(self._compatible)
        self.heads: dict[str, bytes] = {}  # units that begin with a U+2581, without it
        self.bare: dict[str, bytes] = {}
        self.held = 0

    def _merge(self, text: str) -> list[str]:
        parts, none = list(text), float("-inf")
        score = lambda i: self.score.get(parts[i] + parts[i + 1], none)
        scores = [score(i) for i in range(len(parts) - 1)]
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(i - 1)
            if i < len(scores):
                scores[i] = score(i)
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces stay apart, and whole; left -1: there is none."""
        pair = ([self.text[left]] if left >= 0 else []) + [self.text[right]]
        return self._merge("".join(pair)) == pair

    def search(self, unit: str) -> list[int]:
        """Ids of a unit whose characters all have pieces."""
        at: list[list[tuple[int, int]]] = [[] for _ in unit]
        for end, found in self.find.iter(unit):
            at[end - found[1] + 1].append(found)  # matches come by their end, so shorter ones first
        failed, place, which = 0, 0, None
        taken: list[tuple[int, int]] = []  # place, and which of its matches
        while place < len(unit):
            here = at[place]
            which = len(here) if which is None else which
            before = at[taken[-1][0]][taken[-1][1]][0] if taken else -1
            while which:
                which -= 1
                piece, size = here[which]
                if not failed >> (place + size) & 1 and self.compatible(before, piece):
                    taken.append((place, which))
                    place, which = place + size, None
                    break
            else:
                failed |= 1 << place
                place, which = taken.pop()
        return [at[p][k][0] for p, k in taken]

    def unit(self, unit: str) -> list[int]:
        """Ids of any unit; characters without a piece are barriers, written as bytes."""
        known, out, begin = self.id_of, [], 0
        for i, c in enumerate(unit):
            if c not in known:
                if begin < i:
                    out += self.search(unit[begin:i])
                out += [self.byte_id[b] for b in c.encode()]
                begin = i + 1
        return out + (self.search(unit[begin:]) if begin < len(unit) else [])

    def _packed(self, unit: str, head: str, kept: dict[str, bytes]) -> bytes:
        packed = np.array(self.unit(head + unit), np.int32).tobytes()
        if len(unit) <= REMEMBERED_CHARS:
            self.held += ENTRY_BYTES + 2 * len(unit) + len(packed)
            if self.held > REMEMBERED_BYTES:
                self.heads.clear()
                self.bare.clear()
                self.held = 0
            kept[unit] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids as int32, with the end id."""
        out: list[bytes] = []
        if text:
            text = text.replace(SPACE, " ")
            if "  " in text or text[0] == " ":
                for x in _units.findall(SPACE + text.replace(" ", SPACE)):
                    got = self.bare.get(x)
                    out.append(got if got is not None else self._packed(x, "", self.bare))
            else:
                first = True
                for line in text.split("\n"):  # a line end has no piece
                    head, *rest = line.split(" ")
                    if first:
                        rest.insert(0, head)
                        first = False
                    else:
                        out.append(self.line_end)
                        if head:
                            got = self.bare.get(head)
                            out.append(got if got is not None else self._packed(head, "", self.bare))
                    for x in rest:
                        got = self.heads.get(x)
                        out.append(got if got is not None else self._packed(x, SPACE, self.heads))
        out.append(np.int32(self.end_id).tobytes())
        return b"".join(out)

    @property
    def line_end(self) -> bytes:
        got = self.bare.get("\n")
        return got if got is not None else self._packed("\n", "", self.bare)

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids): bytes joined, the first piece without the U+2581 that encoding puts there."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        if ids and self.text.get(ids[0], "").startswith(SPACE):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:  # bytes that no encoding gives
            return self.library.decode(ids)


@lru_cache(2)
def _model(proto: bytes) -> PieceModel:
    return PieceModel(proto)


def read_model(spark, path: str):
    """The model file's bytes, for every task."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model, column: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with ids array<int> of the column's whole texts, the end id last; decoded: also what they decode to."""
    new = {ids: T.ArrayType(T.IntegerType(), False)} | ({decoded: T.StringType()} if decoded else {})
    kept = [f for f in docs.schema.fields if f.name not in new]
    schema = T.StructType([*kept, *(T.StructField(k, t) for k, t in new.items())])

    def scan(batches):
        own = _model(model.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):  # some MB of ids at once
                part = batch.slice(lo, 1000)
                packed = [own.encode(t or "") for t in part.column(column).to_pylist()]
                offsets = np.zeros(len(packed) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
                values = np.frombuffer(b"".join(packed), np.int32)
                columns = [part.column(f.name) for f in kept]
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
                if decoded:
                    columns.append(pa.array([own.decode(np.frombuffer(x, np.int32).tolist()) for x in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(scan, schema)


def decode(rows: DataFrame, model, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the text of their ids (null: empty)."""
    kept = [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(text, T.StringType())])

    def scan(batches):
        own = _model(model.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = pa.array([own.decode(x or []) for x in part.column(ids).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), texts], schema.names)

    return rows.mapInArrow(scan, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark, sf_dir) -> DataFrame:
    """Contract columns of encode() over whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, read_model(spark, default_model()), decoded="decoded").drop("text")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
