"""Operator 1: token ids in seekable binary files.

A file holds one independent zstandard frame per document (its ids, little-endian unsigned 32-bit),
then a skippable frame with the documents' ids and lengths, then the seek table of the public
zstd seekable format: a skippable frame with, per frame, compressed size, plain size and checksum (the low
32 bits of XXH64 of the plain bytes), and a footer.  Any zstd tool can decompress the file as a
whole; :func:`read_documents` decompresses only what is asked for and verifies each checksum.

Documents are range-partitioned by id, so file k holds smaller ids than file k+1.  A task writes to
a name of its own and renames it when complete; the manifest names the files of the tasks that
counted, so a repeated or speculative task leaves nothing that is read.

Nulls: a null text is an empty one, a null id sorts first and is kept.  Repeated ids keep one frame each.
Empty tables give no file and no row.  Other columns are ignored.
"""

from __future__ import annotations

import string
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import store

SKIPPABLE, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Words, and pieces of words, kept with their ids in a worker, and marks of texts that came before.  Only speed depends on them.
MEMO_ENTRIES, MEMO_MARKS = 300_000, 1 << 22
#: UTF-8 bytes of texts, or one longer text, whose different words are looked up together, each once.  Only speed depends on them.
PART_BYTES = 8 << 20
#: The pre-tokenizer pattern of byte-level BPE vocabularies, and their byte alphabet
#: (printable bytes stand for themselves, the others follow from U+0100 on).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
MANIFEST = "file string, n_docs long, n_tokens long, first_doc long"


def _alphabet() -> list[str]:
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in PRINTABLE else chr(next(rest)) for b in range(256)]


class Memo(dict):
    """Ids by text, from a text's second coming on, as most texts come once.  What is kept first stays, as frequent words do;
    after five times as many misses as entries all is forgotten."""

    missed = marked = 0

    def __init__(self):
        self.marks = bytearray(MEMO_MARKS)

    def keep(self, key: str, ids: bytes) -> bytes:
        at = hash(key) % MEMO_MARKS
        if not self.marks[at]:
            self.marks[at] = 1
            self.marked += 1
            if 2 * self.marked > MEMO_MARKS:
                self.marks, self.marked = bytearray(MEMO_MARKS), 0
            return ids
        if len(self) >= MEMO_ENTRIES:
            self.missed += 1
            if self.missed < 5 * MEMO_ENTRIES:
                return ids
            self.clear()
            self.missed = 0
        self[key] = ids
        return ids


class Encoder:
    """Whole texts to ids, by a ``tokenizers`` file of a byte-level BPE vocabulary.

    Such a pre-tokenizer never joins a word to what precedes its one leading space, nor to a single line feed
    between two words, so the ids of ``" word"`` and ``"\\nword"`` can be remembered, and each different word of many
    texts is looked up once.  That holds for printable words below U+3000; a text with any other word or spacing, or
    with the string of an added token, is encoded whole by the library.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        #: Strings that the library takes as one token wherever they stand.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = repr(self.tokenizer.pre_tokenizer)
        self.by_word = self.tokenizer.normalizer is None and kind.startswith("ByteLevel(") and "add_prefix_space=False" in kind and "use_regex=True" in kind
        self.find = regex.compile(PATTERN).findall
        self.table = {b: c for b, c in enumerate(_alphabet())}
        #: Letters below U+0250 in the byte alphabet.
        self.latin = {c: "".join(self.table[b] for b in chr(c).encode()) for c in range(0x250)}
        self.split = self.tokenizer.model.tokenize
        self.packed = [struct.pack("<I", i) for i in range(max(self.tokenizer.get_vocab().values(), default=-1) + 1)]
        #: Ids of a word with its leading space or line feed, and of a piece as the pattern finds it.
        self.words, self.pieces = Memo(), Memo()
        self.feed = self._ids("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, piece: str) -> bytes:
        return self._packed(piece.encode().decode("latin-1").translate(self.table))

    def _packed(self, letters: str) -> bytes:
        return b"".join([self.packed[x.id] for x in self.split(letters)])

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        return self.pieces.keep(piece, self._ids(piece)) if got is None else got

    def _word(self, word: str) -> bytes:
        """Ids of a word that may stand alone, after a line feed, if it begins with one, else after a space.
        Letters alone are one piece; for other words the pattern finds the pieces."""
        if word.isalpha() and ((ascii := word.isascii()) or max(word) < "\u0250"):
            packed = self.packed
            return b"".join([packed[x.id] for x in self.split("\u0120" + (word if ascii else word.translate(self.latin)))])
        if word[:1] != "\n":
            return b"".join([self._piece(p) for p in self.find(" " + word)])
        word = word[1:]
        if word.isalpha() and word.isascii():
            return self.feed + self._packed(word)
        return self.feed + b"".join([self._piece(p) for p in self.find(word)])

    def _known(self, word: str) -> bytes:
        """What :meth:`_word` returns, remembered."""
        got = self.words.get(word)
        return self.words.keep(word, self._word(word)) if got is None else got

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text.  None may be null."""
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_word:
            return [self.whole(t) for t in texts.to_pylist()]
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = split.flatten().dictionary_encode()
        starts, places = split.offsets.to_numpy(), coded.indices.to_numpy().copy()
        bodies, marks = (x.dictionary_encode() for x in _marks_apart(coded.dictionary))
        body_of, mark_of = bodies.indices.to_numpy(), marks.indices.to_numpy()
        words = bodies.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.words.get, words))
        missing = [k for k, x in enumerate(ids) if x is None]
        whole, odd = np.zeros(len(texts), bool), np.zeros(len(words), bool)
        odd[[k for k in missing if _odd(words[k])]] = True
        if odd.any():
            whole = np.logical_or.reduceat(odd[body_of][places], starts[:-1])
        for a in self.added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        # a text's first word has no space before it: it is looked up as a line's first, without the line feed
        firsts, places_of_firsts = np.unique(places[starts[:-1]], return_inverse=True)
        places[starts[:-1]] = len(body_of) + places_of_firsts
        used, wanted = np.zeros(len(body_of) + len(firsts), bool), np.zeros(len(words), bool)
        used[places[np.repeat(~whole, np.diff(starts))]] = True
        wanted[body_of[used[: len(body_of)]]] = True
        for k in np.array(missing, int)[wanted[missing]].tolist():
            ids[k] = self.words.keep(words[k], self._word(words[k]))
        for k, u in zip(body_of[firsts].tolist(), used[len(body_of) :].tolist()):
            ids.append(self._known("\n" + words[k])[len(self.feed) :] if u else b"")
        body_of = np.concatenate([body_of, np.arange(len(words), len(ids))])
        mark_of = np.concatenate([mark_of, mark_of[firsts]])
        joined = pc.binary_join_element_wise(
            pa.array([x or b"" for x in ids], pa.large_binary()).take(pa.array(body_of)),
            pa.array([self._piece(m) for m in marks.dictionary.to_pylist()], pa.large_binary()).take(pa.array(mark_of)),
            pa.scalar(b"", pa.large_binary()),
        ).take(pa.array(places))
        ends, plain = np.frombuffer(joined.buffers()[1], "<i8")[starts].tolist(), memoryview(joined.buffers()[2] or b"")
        return [
            self.whole(texts[k].as_py()) if w else bytes(plain[a:b])
            for k, (a, b, w) in enumerate(zip(ends, ends[1:], whole.tolist()))
        ]


def _odd(word: str) -> bool:
    """Whether a word, a line feed before it or not, may not stand alone."""
    if word.isascii() and word.isalpha():
        return False
    word = word.removeprefix("\n")
    return not word or max(word) >= "\u3000" or not word.isprintable()


#: Bytes of ASCII letters and digits.
ALNUM = np.array([chr(b).isalnum() and b < 0x80 for b in range(256)])


def _marks_apart(words: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray]:
    """Words without the ASCII marks at their end, and these.  Only after a letter or digit (ASCII, or a letter from U+00C0
    to U+00FF) they are pieces of their own; other words stay as they are."""
    trimmed = pc.ascii_rtrim(words, characters=string.punctuation)
    size, body = (pc.binary_length(x).to_numpy() for x in (words, trimmed))
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    at = np.cumsum(size) - size + body - 1
    cut = np.flatnonzero((body > 0) & (body < size))
    last, before = data[at[cut]], data[np.maximum(at[cut] - 1, 0)]
    fine = ALNUM[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
    kept = size.copy()
    kept[cut[fine]] = body[cut[fine]]
    apart = np.repeat(np.tile([False, True], len(size)), np.column_stack([kept, size - kept]).ravel())
    return _strings(kept, data[: len(apart)][~apart]), _strings(size - kept, data[: len(apart)][apart])


def _strings(sizes: np.ndarray, data: np.ndarray) -> pa.StringArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype("<i4")
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(data))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process: what it remembers serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """All rows in order, cut where the bytes of texts pass a multiple of ``PART_BYTES``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // PART_BYTES)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = sink = None
        encode, packer = encoder(tokenizer).encode, zstandard.ZstdCompressor(level=3, write_checksum=True)
        sizes, ids, total = [], [], 0
        end = struct.pack("<I", end_id)
        name = f"{folder}/part-{uuid.uuid4().hex}.ids.zst"
        for batch in batches:
            for part in _parts(batch):
                texts = pc.fill_null(part.column(1), "")
                for doc_id, plain in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    plain += end
                    if sink is None:
                        fs, path = _open(name)
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        sink = fs.open_output_stream(path + ".tmp")
                    frame = packer.compress(plain)
                    sink.write(frame)
                    sizes.append(struct.pack("<III", len(frame), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
                    ids.append(doc_id)
                    total += len(plain) // 4
        if sink is None:
            return
        known = b"".join(struct.pack("<?q", i is not None, i or 0) for i in ids)
        sink.write(struct.pack("<II", SKIPPABLE, len(known)) + known)
        body = b"".join(sizes) + struct.pack("<III", len(known) + 8, 0, 0)
        sink.write(struct.pack("<II", TABLE_MAGIC, len(body) + 9) + body + struct.pack("<IBI", len(sizes) + 1, 0x80, FOOTER_MAGIC))
        sink.close()
        fs.move(path + ".tmp", path)
        yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(ids)], "n_tokens": [total], "first_doc": [ids[0]]}, pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_doc", pa.int64())]))

    return write


class SeekableFile:
    """One file: ``doc_ids`` in order, and documents by their place in it, frame by frame."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self._f = fs.open_input_file(path)
        size = self._f.size()
        n, flags, magic = struct.unpack("<IBI", self._f.read_at(9, size - 9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError(f"{uri}: no seek table")
        table = np.frombuffer(self._f.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.table, self.starts = table[:-1], np.concatenate([[0], np.cumsum(table[:, 0])])
        known = self._f.read_at(int(table[-1, 0]) - 8, int(self.starts[-2]) + 8)
        self.doc_ids = [i if there else None for there, i in struct.iter_unpack("<?q", known)]
        self._unpack = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.table)

    def read(self, k: int) -> bytes:
        packed, plain, check = self.table[k]
        got = self._unpack.decompress(self._f.read_at(int(packed), int(self.starts[k])), max_output_size=int(plain))
        if len(got) != plain or xxhash.xxh64_intdigest(got) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return got

    def close(self) -> None:
        self._f.close()


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Write ids of ``docs(doc_id, text)`` below ``folder``; return the manifest, read from its table.

    The manifest has a row per file, with ``start``, the ids in all files before it: only one number
    per file meets in one place.
    """
    spark = docs.sparkSession
    folder = folder or store.fresh_path(spark, "tokens")
    parts = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sorted_rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    found = sorted_rows.mapInArrow(_writer(f"{folder}/ids", tokenizer, end_id), MANIFEST).collect()
    before, listed = 0, []
    for r in sorted(found, key=lambda r: (r.first_doc is not None, r.first_doc, r.file)):
        listed.append((r.file, r.n_docs, r.n_tokens, before))
        before += r.n_tokens
    spark.createDataFrame(listed, "file string, n_docs long, n_tokens long, start long").coalesce(1).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


STORED = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _reader(wanted: set[int] | None = None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f, at = SeekableFile(row["file"]), row["start"]
                out: list[tuple] = []
                held = 0
                for k, doc_id in enumerate(f.doc_ids):
                    n = int(f.table[k, 1]) // 4
                    if wanted is None or doc_id in wanted:
                        plain = f.read(k)
                        out.append((doc_id, at, n, zlib.crc32(plain), plain))
                        held += len(plain)
                    at += n
                    if held > 8 << 20 or len(out) >= 4096:
                        yield _rows(out)
                        out, held = [], 0
                if out:
                    yield _rows(out)
                f.close()

    return read


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What :func:`read_documents` returns but the ids, which stay in the worker."""
    for batch in _reader()(batches):
        yield batch.select(["doc_id", "start", "n_tokens", "ids_crc32"])


def _files(manifest: DataFrame) -> DataFrame:
    """Files dealt in order over as many tasks as there are shuffle partitions, one each if they suffice."""
    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("file", "start").repartitionByRange(parts, "start", "file")


def read_documents(manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """Per stored document: doc_id, start, n_tokens, ids (binary), ids_crc32; of ``doc_ids`` only
    those frames are decompressed."""
    return _files(manifest).mapInArrow(_reader(None if doc_ids is None else set(doc_ids)), f"{STORED}, ids binary")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` encoded, written and read back from the files."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return store.landed(_files(manifest), "counts", _counts, STORED)
