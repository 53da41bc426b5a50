"""Operator 11: token ids in binary files of independent Zstandard frames with a seek table, as a Spark data source."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from featurelens.llm.text import checkpointed
from featurelens.operators.joins import salted_join
from featurelens.operators.shared import fresh_path

END_ID = 2
FRAME_IDS = 1 << 20            # ids of one frame at most; a longer document takes several frames
FILE_IDS = 1 << 28             # a task begins another file after so many ids
PIECE_CHARS = 1 << 19          # characters given to the tokenizer at once
MEMO_WORDS = 450_000           # distinct words whose ids a worker process keeps, about 100 MB
LEVEL = 1
MANIFEST = "manifest.json"

# Fixed values of the formats: skippable frames, the seekable format's footer, descriptor bit for checksums.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


# ---------------------------------------------------------------- tokens

# A single space between two of these begins a token in byte-level tokenizers, whatever stands around.
_INK = r"[^\s\u180e\ufeff]"
_cut = re.compile(rf"(?<={_INK}) (?={_INK})")
_edges = re.compile(rf"{_INK}(?s:.*){_INK}|{_INK}")
STOPS = ".,;:!?"
LATIN = "\u0250"               # letters below it are letters in every version of the character tables
# Byte-level models write printable Latin-1 bytes as themselves and the others, in order, as characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


def splits_at_spaces(tokenizer: str) -> bool:
    """Whether a tokenizers file gives a text's ids word by word: byte-level with its own pattern, nothing that looks further."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    split, after = spec.get("pre_tokenizer") or {}, spec.get("post_processor") or {"type": "ByteLevel"}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and after["type"] == "ByteLevel"
    alone = all(not set(" " + STOPS) & set(t["content"]) and not t["content"].isalpha() and not t["lstrip"] and not t["rstrip"] and not t["single_word"]
                for t in spec.get("added_tokens", []))
    return bool(plain and alone and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding"))


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """A text in pieces of about ``size``, cut only before spaces at which byte-level tokens begin."""
    start = 0
    while len(text) - start > size:
        found = _cut.search(text, start + size)
        if not found:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:]


class _Uncut(Exception):
    """A word with white space at an end: the text needs cuts that look at both sides."""


class WordCoder(dict):
    """Ids of texts, as bytes, from a tokenizer that gives them word by word: the first ``memo`` words met go through it once.

    Maps a word to the ids of a space and the word, a newline and a word to the ids of both. Stops after a letter are tokens of their own, so a word with stops is the
    word and its stops. A kept word has no white space at its ends, so only others can show that a text needs careful cuts.
    """

    def __init__(self, coder, memo: int = MEMO_WORDS) -> None:
        super().__init__()
        self.coder, self.limit, self.stops = coder, memo, {}

    def encode(self, text: str) -> bytes:
        return array("I", self.coder.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _ends(self, stops: str) -> bytes:
        found = self.stops.get(stops) or self.encode(stops)
        if len(self.stops) < 1024:
            self.stops[stops] = found
        return found

    def __missing__(self, word: str) -> bytes:
        core, keep = word.rstrip(STOPS), True
        letters = core[1:] if core[:1] == "\n" else core
        if letters and len(core) < len(word) and letters[-1].isalpha() and letters[-1] < LATIN:
            keep = core in self         # known without its stops: they may come again
            ids = self[core] + self._ends(word[len(core):])
        elif word[:1] == "\n":
            # a newline between other characters is a token of its own, and the word behind it has no space
            if not _edges.fullmatch(word, 1):
                raise _Uncut
            ids = self._ends("\n") + (self._letters(letters) if letters == word[1:] and letters.isalpha() and max(letters) < LATIN else self.encode(word[1:]))
        elif word.isalpha() and max(word) < LATIN:
            ids = self._letters(" " + word)
        elif _edges.fullmatch(word):
            ids = self.encode(" " + word)
        else:
            raise _Uncut
        if keep and len(self) < self.limit:
            self[word] = ids
        return ids

    def _letters(self, text: str) -> bytes:
        """Letters, with or without a space before, are one pre-token, which the model takes as it is."""
        spelled = text.replace(" ", chr(_ALPHABET[32])) if text.isascii() else text.encode().decode("latin-1").translate(_ALPHABET)
        return array("I", [t.id for t in self.coder.model.tokenize(spelled)]).tobytes()

    def __call__(self, text: str) -> bytes:
        first, *words = text.replace("\n", " \n").split(" ")
        try:
            if words and not _edges.fullmatch(first):
                raise _Uncut
            ids = list(map(self.__getitem__, words))
        except _Uncut:
            first, *words = _cut.split(text)
            ids = list(map(self.__getitem__, words[:-1])) + [self.encode(" " + w) for w in words[-1:]]
        return b"".join([self.encode(first), *ids])


_coders: dict[str, WordCoder] = {}


def _word_coder(tokenizer: str, coder) -> WordCoder:
    """The word coder of a worker process, whose words serve all its tasks."""
    if tokenizer not in _coders:
        _coders.clear()
        _coders[tokenizer] = WordCoder(coder)
    return _coders[tokenizer]


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, frame_ids: int = FRAME_IDS) -> DataFrame:
    """``doc_id, part, ids``: the ids of every row's text with ``end_id`` appended, as little-endian unsigned 32-bit integers.

    ``tokenizer`` is a tokenizers file that every executor reaches. Where it splits at spaces, long texts are given to it in pieces and
    each word once; any other gets whole texts. Ids come in parts of at most ``frame_ids``, the parts of a row one after the
    other and the rows in the order of ``docs``. A null or empty text has the end id alone. Rows that repeat are rows of their
    own. An empty table gives no rows. Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType
    arrow = pa.schema([("doc_id", to_arrow_type(id_type)), ("part", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        coder = Tokenizer.from_file(tokenizer)
        words = _word_coder(tokenizer, coder) if splits_at_spaces(tokenizer) else None
        end, most = struct.pack("<I", end_id), 4 * frame_ids

        def parts(text: str) -> Iterator[bytes]:
            held = b""
            for ids in map(words, safe_pieces(text)) if words is not None else [array("I", coder.encode(text, add_special_tokens=False).ids).tobytes()]:
                held += ids
                while len(held) > most:
                    yield held[:most]
                    held = held[most:]
            held += end
            for at in range(0, len(held), most):
                yield held[at:at + most]

        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for name, text in zip(batch.column("doc_id"), batch.column("text")):
                for n, ids in enumerate(parts(text.as_py() or "")):
                    rows.append((name.as_py(), n, ids))
                    size += len(ids)
                    if size > 4 * FRAME_IDS:
                        yield _batch(rows, arrow)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, arrow)

    kind = T.StructType([T.StructField("doc_id", id_type), T.StructField("part", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# ---------------------------------------------------------------- one file

class FrameWriter:
    """One file: a frame per part of a document, the index of documents, the seek table.

    The seek table is that of the Zstandard seekable format, the last bytes of the file: compressed size, size and checksum (low 32
    bits of XXH64 of the content) of every frame. The index, an Arrow stream ``doc_id, frames, tokens`` with its length and CRC-32, stands
    before it. Both are skippable frames, so that plain decompressors read the file as the ids of all documents.
    """

    def __init__(self, out, id_type: pa.DataType, level: int = LEVEL) -> None:
        self.out, self.id_type = out, id_type
        self.coder = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[list] = []
        self.tokens = 0

    def add(self, doc_id, part: int, ids: bytes) -> None:
        if part == 0:
            self.docs.append([doc_id, 0, 0])
        frame = self.coder.compress(ids)
        self.out.write(frame)
        self.table.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.docs[-1][1] += 1
        self.docs[-1][2] += len(ids) // 4
        self.tokens += len(ids) // 4

    def close(self) -> None:
        schema = pa.schema([("doc_id", self.id_type), ("frames", pa.int32()), ("tokens", pa.int64())])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as stream:
            stream.write_batch(_batch(self.docs, schema))
        index = sink.getvalue().to_pybytes()
        payload = index + struct.pack("<QI", len(index), zlib.crc32(index))
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(payload)) + payload)
        entries = np.array(self.table, "<u4").tobytes()
        footer = struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class FrameReader:
    """Reads the seek table and index of a file, then only the frames asked for; every frame's checksum is compared."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file
        size = file.size()
        n, how, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or how != WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        start = size - 9 - 12 * n - 8
        magic, length = struct.unpack("<II", self._at(start, 8))
        if magic != TABLE_MAGIC or length != 12 * n + 9:
            raise ValueError("damaged seek table")
        self.table = np.frombuffer(self._at(start + 8, 12 * n), "<u4").reshape(n, 3)
        self.offsets = np.concatenate(([0], np.cumsum(self.table[:, 0], dtype=np.int64)))
        length, crc = struct.unpack("<QI", self._at(start - 12, 12))
        index = self._at(start - 12 - length, length)
        if zlib.crc32(index) != crc:
            raise ValueError("damaged index of documents")
        self.docs = pa.ipc.open_stream(index).read_all().combine_chunks()
        self.first = np.concatenate(([0], np.cumsum(self.docs.column("frames").to_numpy(), dtype=np.int64)))
        self.starts = np.concatenate(([0], np.cumsum(self.docs.column("tokens").to_numpy(), dtype=np.int64)))
        self.coder = zstandard.ZstdDecompressor()

    def _at(self, at: int, length: int) -> bytes:
        if at < 0:
            raise ValueError("file is too short")
        self.file.seek(at)
        return self.file.read(length)

    def frame(self, n: int) -> bytes:
        packed, size, checksum = (int(x) for x in self.table[n])
        ids = self.coder.decompress(self._at(int(self.offsets[n]), packed), max_output_size=size)
        if len(ids) != size or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != checksum:
            raise ValueError(f"checksum of frame {n} differs")
        return ids

    def document(self, place: int) -> Iterator[bytes]:
        """The parts of the document at a place of the index."""
        for n in range(int(self.first[place]), int(self.first[place + 1])):
            yield self.frame(n)


# ---------------------------------------------------------------- the data source

@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


@dataclass
class File(InputPartition):
    name: str
    start: int


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, any that pyarrow knows (local, HDFS, S3, GCS)."""
    return fs.FileSystem.from_uri(folder)


def manifest(folder: str) -> dict:
    store, path = _place(folder)
    with store.open_input_stream(f"{path}/{MANIFEST}") as f:
        return json.loads(f.read())


class _Writer(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, folder: str, level: int, file_ids: int) -> None:
        self.schema, self.folder, self.level, self.file_ids = schema, folder, level, file_ids

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _place(self.folder)
        store.create_dir(path, recursive=True)
        id_type = to_arrow_type(self.schema["doc_id"].dataType)
        task, done, out, name = TaskContext.get().partitionId(), [], None, ""

        def finish() -> None:
            if out:
                out.close()
                done.append({"task": task, "roll": len(done), "name": name, "docs": len(out.docs), "tokens": out.tokens})

        for batch in iterator:
            for doc_id, part, ids in zip(batch.column("doc_id"), batch.column("part"), batch.column("ids")):
                part = part.as_py()
                if out is None or (part == 0 and out.tokens >= self.file_ids):
                    finish()
                    # a name of its own for every attempt: only files in the manifest count
                    name = f"ids-{task:06d}-{len(done):04d}-{uuid.uuid4().hex[:12]}.zst"
                    out = FrameWriter(store.open_output_stream(f"{path}/{name}", compression=None), id_type, self.level)
                out.add(doc_id.as_py(), part, ids.as_py())
        finish()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, start = [], 0
        for f in sorted((f for m in messages if m for f in m.files), key=lambda f: (f["task"], f["roll"])):
            files.append({"name": f["name"], "docs": f["docs"], "tokens": f["tokens"], "start": start})
            start += f["tokens"]
        store, path = _place(self.folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps({"id_type": self.schema["doc_id"].dataType.jsonValue(), "files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, path = _place(self.folder)
        for f in (f for m in messages if m for f in m.files):
            store.delete_file(f"{path}/{f['name']}")


class _Reader(DataSourceReader):
    def __init__(self, folder: str, what: str) -> None:
        self.folder, self.what = folder, what

    def partitions(self) -> list[File]:
        return [File(f["name"], f["start"]) for f in manifest(self.folder)["files"]] or [File("", 0)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, path = _place(self.folder)
        with store.open_input_file(f"{path}/{partition.name}") as file:
            source = FrameReader(file)
            rows: list[tuple] = []
            size = 0
            ids, counts = source.docs.column("doc_id"), source.docs.column("tokens").to_pylist()
            schema = _schema(ids.type, self.what)
            for place in range(len(counts)):
                head = (ids[place].as_py(), partition.start + int(source.starts[place]), counts[place])
                if self.what == "index":
                    rows.append((*head, partition.name, place))
                elif self.what == "documents":
                    crc = 0
                    for part in source.document(place):
                        crc = zlib.crc32(part, crc)
                    rows.append((*head, crc))
                else:
                    for n, part in enumerate(source.document(place)):
                        rows.append((*head, n, part))
                        size += len(part)
                        if size > 4 * FRAME_IDS:
                            yield _batch(rows, schema)
                            rows, size = [], 0
                if len(rows) >= 10_000:
                    yield _batch(rows, schema)
                    rows, size = [], 0
            yield _batch(rows, schema)


def _schema(id_type: pa.DataType, what: str) -> pa.Schema:
    more = {"documents": [("ids_crc32", pa.int64())], "parts": [("part", pa.int32()), ("ids", pa.binary())], "index": [("file", pa.string()), ("place", pa.int32())]}
    return pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64()), *more[what]])


class TokenFiles(DataSource):
    """Format ``token_files``. Writes ``doc_id, part, ids``; reads by the option ``what``: documents, parts or index."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def _what(self) -> str:
        return self.options.get("what", "parts")

    def schema(self) -> T.StructType:
        id_type = T._parse_datatype_json_value(manifest(self.options["path"])["id_type"])
        return T.StructType([T.StructField(f.name, from_arrow_type(f.type)) for f in _schema(to_arrow_type(id_type), self._what())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._what())

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(schema, self.options["path"], int(self.options.get("level", LEVEL)), int(self.options.get("file_ids", FILE_IDS)))


# ---------------------------------------------------------------- whole tables

def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID, level: int = LEVEL, file_ids: int = FILE_IDS) -> str:
    """Write the token ids of all documents in ascending order of id (null first; repeated ids by the hash of the text) and return the folder.

    The texts are dealt by ranges of ids and tokenized once, where they are written: each task writes its range to files of
    frames, and the manifest, written when all tasks are done, orders them and names where each file's ids start. Files of
    lost or repeated attempts are in no manifest. ``folder``: a URI that pyarrow opens on every executor, by default a new one
    in the shared folder. An empty table gives a manifest without files. Texts and ids: see ``tokenize``; an id is of any type that
    Spark orders.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    folder = folder or fresh_path(spark, "tokens")
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.asc("_h"), F.asc("_row")]
    ranged = narrow.withColumn("_h", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    tokens = tokenize(ranged.select("doc_id", "text"), tokenizer, end_id=end_id)
    tokens.write.format("token_files").option("path", folder).option("level", level).option("file_ids", file_ids).mode("append").save()
    return folder


def read_token_files(spark: SparkSession, folder: str, what: str = "parts") -> DataFrame:
    """The files of a folder, one task per file. ``start`` is the number of ids of all documents before.

    ``parts``: ``doc_id, start, n_tokens, part, ids``. ``documents``: ``doc_id, start, n_tokens, ids_crc32`` of the ids as they are
    decompressed. ``index``: ``doc_id, start, n_tokens, file, place`` without decompressing anything.
    """
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").option("path", folder).option("what", what).load()


def requested_documents(folder: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, start, n_tokens, part, ids`` of the documents whose id is in ``wanted``; only their frames are decompressed.

    Ids that repeat in ``wanted`` count once, unknown and null ids give nothing, rows that repeat an id in the files all come.
    """
    spark = wanted.sparkSession
    index = read_token_files(spark, folder, "index")
    keys = wanted.select(F.col(f"`{id_col}`").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    found = checkpointed(salted_join(index, keys, ["doc_id"], salt_by=["file", "place"]))
    schema = _schema(to_arrow_type(index.schema["doc_id"].dataType), "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _place(folder)
        opened, source = "", None
        for batch in batches:
            for doc_id, start, n, name, place in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "file", "place"))):
                if name != opened:
                    opened, source = name, FrameReader(store.open_input_file(f"{path}/{name}"))
                for part, ids in enumerate(source.document(place)):
                    yield _batch([(doc_id, start, n, part, ids)], schema)

    kind = T.StructType([T.StructField(f.name, from_arrow_type(f.type)) for f in schema])
    return found.repartitionByRange("file", "place").sortWithinPartitions("file", "place").mapInArrow(run, kind)


def ids_of(parts: Iterable[bytes]) -> np.ndarray:
    """The ids in the parts of a document."""
    return np.frombuffer(b"".join(parts), "<u4")
