"""Token-ID output as directly addressable codes: chunk levels, continuation bitmaps and rank directories."""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common as C

MAGIC, CHUNK_BITS, RANK_BLOCK = b"DAC1", 8, 512
#: A file is closed after this many ids; a document is never split.
FILE_IDS = 8_000_000
CACHE_WORDS = 800_000
#: Texts that are coded at once.
BATCH = 1024
END_ID = 1


class DirectCodes:
    """A sequence of unsigned ids in 8-bit levels.

    Level 0 has the low byte of every id; bit i of its bitmap says that id i goes on in level 1, at the place given
    by the number of set bits before i: the rank directory has that number for each block of 512 bits, and a
    popcount over at most 64 bytes gives the rest.  So any id is read in as many steps as it has bytes.
    """

    def __init__(self, levels: list[np.ndarray], bitmaps: list[np.ndarray], ranks: list[np.ndarray]):
        self.levels, self.bitmaps, self.ranks = levels, bitmaps, ranks

    @classmethod
    def encode(cls, ids: np.ndarray) -> DirectCodes:
        levels, bitmaps, ranks, rest = [], [], [], ids.astype(np.uint64)
        while True:
            levels.append((rest & np.uint64(255)).astype(np.uint8))
            rest = rest >> np.uint64(CHUNK_BITS)
            more = rest > 0
            if not more.any():
                return cls(levels, bitmaps, ranks)
            bits = np.packbits(more, bitorder="little")
            padded = np.zeros(-(-len(more) // RANK_BLOCK) * RANK_BLOCK, bool)
            padded[: len(more)] = more
            each = padded.reshape(-1, RANK_BLOCK).sum(1, dtype=np.int64)
            bitmaps.append(bits)
            ranks.append((np.cumsum(each) - each).astype("<u4"))
            rest = rest[more]

    def __len__(self) -> int:
        return len(self.levels[0])

    def __getitem__(self, i: int) -> int:
        value = 0
        for k, level in enumerate(self.levels):
            value |= int(level[i]) << (CHUNK_BITS * k)
            if k == len(self.bitmaps) or not self.bitmaps[k][i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BLOCK
            part = bytes(self.bitmaps[k][block * RANK_BLOCK // 8 : (i >> 3) + 1])
            ones = int.from_bytes(part, "little") & ((1 << (i - block * RANK_BLOCK)) - 1)
            i = int(self.ranks[k][block]) + ones.bit_count()
        return value

    def decode(self) -> np.ndarray:
        """All ids, level by level."""
        value: np.ndarray | None = None
        for k in range(len(self.levels) - 1, -1, -1):
            own = self.levels[k].astype(np.uint32)
            if value is not None:
                on = np.unpackbits(self.bitmaps[k], count=len(own), bitorder="little").astype(bool)
                own[on] |= value << np.uint32(CHUNK_BITS)
            value = own
        return value

    def pack(self) -> bytes:
        out = [struct.pack("<I", len(self.levels))]
        for k, level in enumerate(self.levels):
            last = k == len(self.bitmaps)
            out += [struct.pack("<QQ", len(level), 0 if last else len(self.ranks[k])), level.tobytes()]
            out += [] if last else [self.bitmaps[k].tobytes(), self.ranks[k].tobytes()]
        return b"".join(out)

    @classmethod
    def unpack(cls, data: bytes) -> DirectCodes:
        (count,), at = struct.unpack_from("<I", data), 4
        levels, bitmaps, ranks = [], [], []
        for _ in range(count):
            n, r = struct.unpack_from("<QQ", data, at)
            levels.append(np.frombuffer(data, np.uint8, n, at + 16))
            at += 16 + n
            if r:
                bitmaps.append(np.frombuffer(data, np.uint8, -(-n // 8), at))
                at += -(-n // 8)
                ranks.append(np.frombuffer(data, "<u4", r, at))
                at += 4 * r
        return cls(levels, bitmaps, ranks)


def write_file(path: str, ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray) -> None:
    """Magic, number of documents, their ids (int64, the least for null), where each one's ids end, the codes."""
    fs, at = pafs.FileSystem.from_uri(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    with fs.open_output_stream(at) as f:
        f.write(b"".join((MAGIC, struct.pack("<Q", len(doc_ids)), doc_ids.astype("<i8").tobytes(), ends.astype("<u8").tobytes(), DirectCodes.encode(ids).pack())))


def read_file(path: str) -> tuple[np.ndarray, np.ndarray, DirectCodes]:
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(at) as f:
        data = f.read()
    if data[:4] != MAGIC:
        raise ValueError(f"{path} isn't a file of direct codes")
    (n,) = struct.unpack_from("<Q", data, 4)
    return np.frombuffer(data, "<i8", n, 12), np.frombuffer(data, "<u8", n, 12 + 8 * n), DirectCodes.unpack(data[12 + 16 * n :])


class TokenFile:
    """Random access to a file of ``write_file``: any id is read with a few seeks, no block is decoded."""

    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(path)
        self.f = fs.open_input_file(at)
        if self._read(0, 4) != MAGIC:
            raise ValueError(f"{path} isn't a file of direct codes")
        (self.n_docs,) = struct.unpack("<Q", self._read(4, 8))
        at = 12 + 16 * self.n_docs
        (count,), at = struct.unpack("<I", self._read(at, 4)), at + 4
        self.levels: list[tuple[int, int, int, int]] = []  # ids, places of bytes, bitmap and ranks
        for _ in range(count):
            n, r = struct.unpack("<QQ", self._read(at, 16))
            bitmap = at + 16 + n
            self.levels.append((n, at + 16, bitmap, bitmap + -(-n // 8)))
            at = bitmap + (-(-n // 8) + 4 * r if r else 0)

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def __len__(self) -> int:
        return self.levels[0][0]

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (_, level, bitmap, ranks) in enumerate(self.levels):
            value |= self._read(level + i, 1)[0] << (CHUNK_BITS * k)
            if k + 1 == len(self.levels):
                break
            block = i // RANK_BLOCK
            first = block * RANK_BLOCK // 8
            part = int.from_bytes(self._read(bitmap + first, (i >> 3) + 1 - first), "little")
            if not part >> (i - block * RANK_BLOCK) & 1:
                break
            ones = part & ((1 << (i - block * RANK_BLOCK)) - 1)
            i = struct.unpack("<I", self._read(ranks + 4 * block, 4))[0] + ones.bit_count()
        return value

    def document(self, k: int) -> tuple[int | None, range]:
        """The id of the k-th document and where its ids are."""
        if not 0 <= k < self.n_docs:
            raise IndexError(k)
        (doc_id,) = struct.unpack("<q", self._read(12 + 8 * k, 8))
        ends = 12 + 8 * self.n_docs
        start = struct.unpack("<Q", self._read(ends + 8 * (k - 1), 8))[0] if k else 0
        return None if doc_id == np.iinfo(np.int64).min else doc_id, range(start, struct.unpack("<Q", self._read(ends + 8 * k, 8))[0])


def _byte_chars() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()
SYMBOLS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: What tells whether a tokenizer can be asked word by word.
PROBES = ("a", "The  QUICK brown,fox\n\njumps\tover", " lead and trail ", "don't it's we'LL 's", "x1 22 333 4.5 1,000", "été Größe ÀÉÎ ß", "İ ΟΔΟΣ 漢字 ﬁ ½", "--- (a) [b]... #tag @x http://a.b/c?d=e", "word_word aaaaaaaa zzzzzz", "")


class Words(dict):
    """White-space delimited bytes to their ids as little-endian uint32: this tokenizer never joins across white space.

    A run of letters before U+0130 is one piece for the vocabulary's model, whatever ASCII symbols but an apostrophe
    follow it; such words skip normalizing and splitting, and share what their letters and their symbols were coded as.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.whole = False
        self.whole = not self._agrees()

    def _agrees(self) -> bool:
        """Whether words one by one give what the tokenizer gives of whole texts; if not, whole texts are encoded."""
        for x in PROBES:
            try:
                if self.ids([x.encode()], b"")[0] != struct.pack(f"<{len(i := self.tokenizer.encode(x, add_special_tokens=False).ids)}I", *i):
                    return False
            except Exception:  # noqa: BLE001: a model that can't take such pieces doesn't agree
                return False
        self.clear()
        return True

    def letters(self, s: str) -> bytes:
        piece = s.lower().encode().decode("latin-1").translate(BYTE_CHARS)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(piece)])

    def learn(self, words: set[bytes]) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
        hard: list[bytes] = []
        after: list[tuple[bytes, bytes, bytes]] = []
        tokenize = self.model.tokenize
        for w in words.difference(self):
            if w.isalpha():  # ASCII letters stand for themselves
                self[w] = b"".join([t.id.to_bytes(4, "little") for t in tokenize(w.lower().decode())])
                continue
            s = w.decode("utf-8", "replace")
            core = s.rstrip(SYMBOLS)
            if core and core.isalpha() and max(core) < "\u0130":
                if len(core) == len(s):
                    self[w] = self.letters(core)
                else:
                    c, tail = core.encode(), s[len(core) :].encode()
                    if c not in self:
                        self[c] = self.letters(core)
                    if tail not in self:
                        hard.append(tail)
                        self[tail] = b""
                    after.append((w, c, tail))
            else:
                hard.append(w)
        for at in range(0, len(hard), 4096):
            some = hard[at : at + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)):
                i = e.ids
                self[w] = struct.pack(f"<{len(i)}I", *i)
        for w, c, tail in after:
            self[w] = self[c] + self[tail]

    def ids(self, texts: list[bytes], end: bytes) -> list[bytes]:
        """A batch of texts.  A-Z are lower-cased first, as the tokenizer does, but where a special token may stand."""
        if self.whole:
            return [struct.pack(f"<{len(e.ids)}I", *e.ids) + end for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)]
        split = [(x if b"<|" in x else x.lower()).split() for x in texts]
        self.learn(set().union(*split))
        get = self.__getitem__
        return [b"".join(map(get, w)) + end for w in split]

    def ids_of(self, column: pa.Array, end: bytes) -> list[bytes]:
        """The same of a column of texts, null being empty: no word is an object of its own but the distinct ones."""
        column = column.fill_null("")
        if self.whole:
            return self.ids(C.texts(column), end)
        special = pc.match_substring(column, "<|").to_numpy(zero_copy_only=False)
        at, sizes, words = C.words_of(pc.if_else(pa.array(special), pa.scalar("", column.type), column) if special.any() else column)
        self.learn(set(words))
        codes = [self[w] for w in words]
        own = np.array([len(x) // 4 for x in codes], np.int64)
        flat = np.frombuffer(b"".join(codes), "<u4")
        each = own[at]
        places = np.repeat((np.cumsum(own) - own)[at] - (np.cumsum(each) - each), each)
        places += np.arange(len(places))
        upto = np.r_[0, np.cumsum(each)][np.cumsum(sizes)]  # ids up to each text's end
        data = np.insert(flat[places], upto, np.frombuffer(end, "<u4")[0]).tobytes() if end else flat[places].tobytes()
        ends = 4 * (upto + (np.arange(1, len(upto) + 1) if end else 0))
        out = [data[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]
        for k in np.flatnonzero(special).tolist():
            out[k] = self.ids([column[k].as_py().encode()], end)[0]
        return out


_words: dict[str, Words] = {}


def write_tokens(docs: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of all documents, in ascending id order, to files under ``out``; returns their manifest.

    Null text is written as empty: the end id only.  Null ids come first and repeated ids stand beside each other.
    An empty table writes no files.  Any tokenizer file will do; one that can be asked word by word is.  Other columns are ignored.  A range partition is read, encoded and written by
    one task; a file's name is its attempt's own and only attempts that Spark committed are in the manifest.
    """
    spark = docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()

    def encode(it):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _words:
            _words[tokenizer] = Words(tokenizer)
        schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        own: list[int] = []

        def flush():
            path = f"{out}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.dac"
            ends = np.cumsum([len(x) // 4 for x in ids])
            write_file(path, np.frombuffer(b"".join(ids), "<u4"), np.array(own, np.int64), ends)
            return C.table(schema, [part], [seq], [path], [len(own)], [int(ends[-1])])

        held = 0
        for b in C.batches(it, BATCH):
            for d, x in zip(b.column(0).to_pylist(), _words[tokenizer].ids_of(b.column(1), end)):
                if held and held + len(x) // 4 > file_ids:
                    yield flush()
                    seq, ids, own, held = seq + 1, [], [], 0
                ids.append(x)
                own.append(np.iinfo(np.int64).min if d is None else d)
                held += len(x) // 4
        if own:
            yield flush()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Rows that repeat an id, or have none, spread by their texts.
    order = ["doc_id", F.xxhash64("text")]
    ordered = slim.repartitionByRange(C.parts(spark), *order).sortWithinPartitions(*order)
    return C.materialize(ordered.mapInArrow(encode, "part long, seq long, path string, n_docs long, n_ids long"), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files; the manifest has one row per file."""
    # One window over the manifest: a row per file of some million ids.
    starts = manifest.withColumn("start", F.sum("n_ids").over(Window.orderBy("part", "seq")) - F.col("n_ids"))
    files = starts.select("path", "start").repartition(C.parts(manifest.sparkSession), "path")

    def decode(it):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in it:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc_ids, ends, codes = read_file(path)
                data = memoryview(codes.decode().astype("<u4").tobytes())
                ends = ends.astype(np.int64)
                begins = np.r_[0, ends[:-1]]
                crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(begins.tolist(), ends.tolist())]
                null = doc_ids == np.iinfo(np.int64).min
                yield C.table(schema, pa.array(doc_ids, mask=null), begins + start, ends - begins, crc)

    return files.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, out: str | None = None, **columns) -> DataFrame:
    """Writes (``write_tokens``) and reads back (``read_tokens``)."""
    return read_tokens(write_tokens(docs, out or C.fresh_path(docs.sparkSession, "tokens", True), tokenizer, **columns))
