"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code.

The ids of a block are counted and replaced by their rank in it, the most
frequent first, so that most take a byte. A rank is written in one to four
little-endian bytes; the lengths stand apart, two bits each, four in a control
byte. Readers take four lengths at a time from a table of the 256 control bytes
and gather the bytes with numpy.

A token file holds one range of the documents in doc_id order, in blocks that
can be read alone:

    8 bytes   "RANKVLC3"
    6 x int64 documents, ids, distinct ids, bytes of names, control bytes, data bytes of the block
    int64     ids of each document
    bytes     names: the documents' doc_ids, an Arrow IPC stream
    uint32    id of each rank
    bytes     controls, then data; the next block follows

Documents are dealt into ranges of doc_id, each sorted and written by one task
in blocks of bounded size; the manifest names the files of tasks that succeeded
with their numbers of documents and ids, so a task that runs again does no harm.
Texts are encoded once, and only a block's ids are held.

A null text is empty and has the end id only. Null doc_ids come first; documents
with equal doc_ids all stay, ordered by a hash of their text, and may lie in several
files. A very long text is one document of one block. An empty table gives no
files. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import uuid
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import new_path, partitions, pieces, written

MAGIC = b"RANKVLC3"
END_ID = 0
#: Ids in a block, at least (a document isn't cut). Its rank table adds about a fiftieth.
BLOCK_IDS = 1 << 21
#: Bytes of the table's files for each token file, where the session's number of partitions is too small.
FILE_BYTES = 256 << 20
#: Bytes of words and their ids that a task remembers, and what one takes beside these.
REMEMBERED_BYTES, ENTRY_BYTES = 192 << 20, 200

_runs = re.compile(r"(\s+)")
#: What libraries differ about, whether it is white space.
_odd = re.compile(r"[\x1c-\x1f\x85]")


def plain(text: str) -> bool:
    """Whether all its white space is single spaces or line ends between words."""
    words, breaks = text.split(), text.count(" ") + text.count("\n")
    return len(words) == breaks + 1 and len("".join(words)) + breaks == len(text)


def units(text: str) -> list[str]:
    """Any text in pieces that byte-level BPE with its usual word pattern encodes one by one.

    The pattern splits at white space: a space belongs to the word behind it, of
    any longer run only the last character is looked at with that word.
    """
    if _odd.search(text):
        return [text]
    out, parts, carried = [], _runs.split(text), ""
    for i, x in enumerate(parts):
        if i % 2 == 0:
            if x:
                out.append(carried + x)
            carried = ""
        elif i == len(parts) - 2 and not parts[-1]:
            out.append(x)
        else:
            out += [x[:-1]] if len(x) > 1 else []
            carried = x[-1]
            if carried != " ":
                out.append(carried)
                carried = ""
    return out


class TextEncoder:
    """tokenizers' encode() of whole texts, word by word, with what it said of a word remembered."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]  # the library looks for them before it parts words
        self.tokenize = self.library.model.tokenize
        # the printable characters that stand for bytes, as the library maps them
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
        hidden = (b for b in range(256) if b not in shown)
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.spaced: dict[str, bytes] = {}  # words behind a space, without it
        self.bare: dict[str, bytes] = {}
        self.held = 0
        self.mark = {c: self.whole(c) for c in ".,:;!?"}
        self.line_end = self.whole("\n")
        for x in (" The", "word", " Größe", " naïve", " слово", "ção"):
            if self.letters(x) != self.whole(x):
                raise ValueError("not a byte-level model with the usual word pattern")

    def whole(self, text: str) -> bytes:
        """By the library, all of it."""
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, word: str) -> bytes:
        """By the library's model; the word is letters, or a space and letters."""
        shown = word.replace(" ", self.alphabet[0x20]) if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def word(self, word: str, space: str) -> bytes:
        kept = self.spaced if space else self.bare
        if word.isalpha():
            got = self.letters(space + word)
        elif word[-1:] in self.mark and word[:-1].isalpha():
            got = (kept.get(word[:-1]) or self.word(word[:-1], space)) + self.mark[word[-1]]
        else:
            got = self.whole(space + word)
        if self.held < REMEMBERED_BYTES and len(word) <= 48:  # the frequent words come early
            kept[word] = got
            self.held += ENTRY_BYTES + 2 * len(word) + len(got)
        return got

    def encode(self, text: str) -> bytes:
        """Ids as uint32, without an end id."""
        if any(t in text for t in self.added):
            return self.whole(text)
        if not plain(text):
            return b"".join(map(self.whole, units(text)))
        out = []
        for i, line in enumerate(text.split("\n")):
            head, *rest = line.split(" ")
            if i:
                out.append(self.line_end)
            out.append(self.bare.get(head) or self.word(head, ""))
            got = list(map(self.spaced.get, rest))
            if None in got:
                got = [g or self.word(w, " ") for g, w in zip(got, rest, strict=True)]
            out += got
        return b"".join(out)


@lru_cache(1)
def _encoder(spec: str) -> TextEncoder:
    return TextEncoder(spec)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(controls, data) of ranks."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = size - 1
    controls = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return controls.astype(np.uint8).tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


#: The four lengths of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def unpack(controls: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks that pack() was given."""
    sizes = LENGTHS[np.frombuffer(controls, np.uint8)].reshape(-1)[:n]
    raw = np.zeros((n, 4), np.uint8)
    raw[np.arange(4) < sizes[:, None]] = np.frombuffer(data, np.uint8)
    return raw.view("<u4").reshape(-1).astype(np.uint32)


def _names(doc_ids: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(doc_ids)], ["doc_id"])


def _write_block(out, doc_ids: list, lengths: list[int], packed: list[bytes]) -> None:
    ids = np.frombuffer(b"".join(packed), np.uint32)
    counts = np.bincount(ids)
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]  # equal counts: the smaller id first
    rank = np.zeros(len(counts), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    controls, data = pack(rank[ids])
    names, sink = _names(doc_ids), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, names.schema) as stream:
        stream.write_batch(names)
    names = sink.getvalue().to_pybytes()
    out.write(MAGIC + np.array([len(lengths), len(ids), len(order), len(names), len(controls), len(data)], "<i8").tobytes())
    out.write(np.array(lengths, "<i8").tobytes() + names + order.astype("<u4").tobytes() + controls + data)


def read_blocks(stream):
    """(doc_ids, lengths, ids) of each block of a token file."""
    while head := stream.read(56):
        if head[:8] != MAGIC or len(head) != 56:
            raise ValueError("not a token file")
        docs, n, distinct, names, c, d = np.frombuffer(head[8:], "<i8").tolist()
        lengths = np.frombuffer(stream.read(8 * docs), "<i8")
        doc_ids = pa.ipc.open_stream(stream.read(names)).read_next_batch().column(0)
        id_of = np.frombuffer(stream.read(4 * distinct), "<u4")
        yield doc_ids, lengths, id_of[unpack(stream.read(c), stream.read(d), n)]


def write_tokens(docs: DataFrame, spec, path: str) -> DataFrame:
    """Writes the token files and returns their manifest: part, file, n_docs, n_ids."""
    fs, root = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)

    def write(batches):
        from pyspark import TaskContext

        own = _encoder(spec.value)
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"  # each attempt has a file of its own
        fs, root = pa.fs.FileSystem.from_uri(path)
        docs, total, out = 0, 0, None
        names, lengths, packed, waiting = [], [], [], 0
        end = np.uint32(END_ID).tobytes()
        for batch in batches:
            out = out or fs.open_output_stream(f"{root}/{name}")
            begin = 0  # of the block's documents in this batch
            for k, text in enumerate(batch.column(1)):
                x = own.encode(text.as_py() or "")
                packed += [x, end]
                lengths.append(len(x) // 4 + 1)
                waiting += lengths[-1]
                if waiting >= BLOCK_IDS:
                    _write_block(out, [*names, batch.column(0).slice(begin, k + 1 - begin)], lengths, packed)
                    docs, total = docs + len(lengths), total + waiting
                    names, lengths, packed, waiting, begin = [], [], [], 0, k + 1
            if begin < batch.num_rows:
                names.append(batch.column(0).slice(begin))
        if lengths:
            _write_block(out, names, lengths, packed)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([docs + len(lengths)]), pa.array([total + waiting])], ["part", "file", "n_docs", "n_ids"])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(pieces(docs, FILE_BYTES), *order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(write, "part long, file string, n_docs long, n_ids long"), "manifest")


def read_tokens(manifest: DataFrame, path: str, id_type: str = "long") -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids (as little-endian uint32)."""
    spark = manifest.sparkSession
    # a row for each file: files are as many as the tasks that wrote them
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches):
        fs, root = pa.fs.FileSystem.from_uri(path)
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_stream(f"{root}/{file}") as f:
                    for doc_ids, lengths, ids in read_blocks(f):
                        ends = np.cumsum(lengths)
                        starts = ends - lengths
                        raw = ids.astype("<u4").tobytes()
                        for lo in range(0, len(lengths), 500):
                            part = slice(lo, lo + 500)
                            values = [raw[4 * a : 4 * b] for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
                            yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, len(values)), pa.array(start + starts[part]), pa.array(lengths[part]), pa.array(values)], ["doc_id", "start", "n_tokens", "ids"])
                        start += int(ends[-1])

    dealt = files.select("file", "first").repartition(partitions(spark), "file")
    return dealt.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids binary")


def default_tokenizer(spark):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def op10_token_files(spark, sf_dir) -> DataFrame:
    """Contract columns: whole documents, written as token files and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = new_path(spark, "tokens")
    manifest = write_tokens(docs, default_tokenizer(spark), path)
    return read_tokens(manifest, path, docs.schema["doc_id"].dataType.simpleString()).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
