"""BPE encoding and decoding through a distinct-word table.

The tokenizer cuts normalised text into words and merges within a word only, so a word has the
same ids wherever it stands. Words are counted in Spark (``word_table``) and each frequent one is
encoded once; texts then look their words up in that table, one by one in the order of their
positions, and decoding looks ids up in the id-to-piece table, which the vocabulary bounds. Both
are joins with a broadcast table inside the task that holds the text: no table of positions is
shuffled, as its rows would take several times the space of the texts.

The table of a corpus has no bound: rare words keep coming. The part that is sent to all tasks is
held to ``TABLE_WORDS`` words, the most frequent ones, found by a histogram of counts; they are
the bulk of any text. A word beyond it is encoded by the task that meets it, once while it
stays in that task's bounded memo. Results are the same for either way.

Edge cases: null text is the empty text, without ids; texts of any length are handled whole, one
at a time; special tokens in a text become their own ids, as in the library; words that tie for a
place in the table are taken or left together; repeated rows repeat; an empty table gives an empty
result; columns named like an output (``ids``, ``decoded``) are replaced, any others are carried.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.runtime import small_batches, stash, temporary

TABLE_WORDS = 150_000
MEMO_WORDS = 100_000
COUNT_WORDS = 150_000

#: ASCII members of the classes that a split pattern may name.
ASCII = {r"\p{L}": "a-zA-Z", r"\p{N}": "0-9", r"\s": r"\t-\r "}


def _settings(path: str) -> tuple[dict[str, int], str]:
    """The special tokens and the split pattern of a tokenizer file.

    Files of another build than this module handles are refused: special tokens taken as they
    stand, NFC, runs of white space to a space, lower case, one split pattern, bytes, no decoder.
    """
    import json

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    steps = [(x["type"], x.get("pattern", {}).get("Regex"), x.get("content")) for x in (made["normalizer"] or {}).get("normalizers", [])]
    split, *rest = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    plain = all(not t[k] for t in made["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    whole = [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in rest] == [("ByteLevel", False, False)]
    pattern = split.get("pattern", {}).get("Regex", "") if (split.get("type"), split.get("behavior"), split.get("invert")) == ("Split", "Removed", True) else ""
    known = steps == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)] and made["decoder"] is None and made["model"]["type"] == "BPE"
    if not (plain and whole and known and pattern) or re.search(r"\\[pPwWdDbBSuUx]", re.sub(r"\\p\{[LN]\}", "", pattern)):
        raise ValueError(f"{path}: a tokenizer of another build than normalised words split by one pattern")
    return {t["content"]: t["id"] for t in made["added_tokens"]}, pattern


def _filled(pattern: str, classes: dict[str, str]) -> re.Pattern:
    for name, members in classes.items():
        pattern = pattern.replace(name, members)
    return re.compile(pattern)


class Splitter:
    """Cuts a text as the tokenizer does: special tokens, NFC, lower case, then its pattern.

    Texts of the basic plane take compiled patterns whose letters, digits and spaces are asked of
    the library once; a text with other characters, or with one that the library's tables
    normalise in another way than Python's, is left to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.specials, pattern = _settings(path)
        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        self.library = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        plane = [chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
        whole = "".join(plane)

        def ranges(kind: str) -> str:
            found = (span for _, span in pre_tokenizers.Split(Regex(kind), "removed", invert=True).pre_tokenize_str(whole))
            return "".join(f"{re.escape(whole[i])}-{re.escape(whole[j - 1])}" for i, j in _consecutive(found, whole))

        classes = {name: known + ranges(f"[{name}]+") for name, known in ASCII.items()}
        self.wide, self.ascii = _filled(pattern, classes), _filled(pattern, ASCII)
        spaces = classes[r"\s"]
        space = re.compile(f"[{spaces}]")
        odd = [c for c in plane if self.normalise(c) != (" " if space.match(c) else self.lower(c))]
        self.odd = re.compile("[\U00010000-\U0010ffff" + "".join(map(re.escape, odd)) + "]")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.mark = os.path.commonprefix(list(self.specials))

    @staticmethod
    def lower(text: str) -> str:
        """NFC and lower case letter by letter: a final sigma is not told apart."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def __call__(self, text: str) -> list[str]:
        if self.specials and self.mark in text:
            return list(chain.from_iterable([s] if s in self.specials else self.words(s) for s in self.special.split(text)))
        return self.words(text)

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text.lower())
        if self.odd.search(text):
            return [piece for piece, _ in self.library(self.normalise(text))]
        return self.wide.findall(self.lower(text))


def _consecutive(spans, whole: str):
    """Spans of ``whole``, cut where its characters are not consecutive."""
    for i, j in spans:
        start = i
        for k in range(i + 1, j):
            if ord(whole[k]) != ord(whole[k - 1]) + 1:
                yield start, k
                start = k
        yield start, j


def _tokenizer(path: str):
    """The tokenizer without its normalizer: words come normalised, and a cut-out mark must stay."""
    import json

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        return Tokenizer.from_str(json.dumps(json.load(f) | {"normalizer": None}))


def _width(tokenizer) -> str:
    """How ids are packed: two bytes each if the vocabulary allows."""
    return "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def _word_ids(tokenizer, specials: dict[str, int], words: list[str]) -> list[bytes]:
    """The packed ids of each word."""
    width = _width(tokenizer)
    coded = tokenizer.encode_batch(words, add_special_tokens=False)
    return [np.array([specials[w]] if w in specials else e.ids, width).tobytes() for w, e in zip(words, coded, strict=True)]


class Memo(dict):
    """Packed ids of words; those not in the table are encoded when first met."""

    def __init__(self, table: dict, path: str):
        super().__init__(table)
        self.specials = _settings(path)[0]
        self.tokenizer, self.most = _tokenizer(path), len(table) + MEMO_WORDS
        self.table, self.width = table, _width(self.tokenizer)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
            self.update(self.table)
        ids = self[word] = _word_ids(self.tokenizer, self.specials, [word])[0]
        return ids


def word_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word, n) for every distinct word of all texts; counted within tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = Splitter(path), Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for x in batch.column(0):
                if x.is_valid:
                    seen.update(split(x.as_py()))
                    if len(seen) > COUNT_WORDS:
                        yield flush()
                        seen.clear()
        yield flush()

    return docs.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """(word, n) -> adds ``ids``, packed: each distinct word is encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, specials = _tokenizer(path), _settings(path)[0]
        for batch in batches:
            ids = _word_ids(tokenizer, specials, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["word", "n", "ids"])

    return words.select("word", "n").mapInArrow(encode, "word string, n bigint, ids binary")


def frequent(words: DataFrame, most: int = TABLE_WORDS) -> DataFrame:
    """The most frequent words, at most ``most``: whole classes of count, from a histogram."""
    level = F.floor(F.log2("n") * 8)
    counts = words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    total, least = 0, None
    for row in counts:  # at most 8 * 63 classes
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    return words.where(level >= least) if least is not None else words.limit(0)


def shared_table(docs: DataFrame, path: str, text: str = "text"):
    """The frequent words' ids as a broadcast variable; at most ``TABLE_WORDS`` entries."""
    with temporary(docs.sparkSession):
        words = stash(word_table(docs, path, text), "bpe-words")
        rows = encoded_words(frequent(words), path).select("word", "ids").toArrow()
    table = dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
    return docs.sparkSession.sparkContext.broadcast(table)


def pieces(path: str) -> list[str]:
    """The id-to-piece table, by id."""
    tokenizer = _tokenizer(path)
    return [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]


def encode_decode(docs: DataFrame, path: str, text: str = "text", decode: bool = True) -> DataFrame:
    """``docs`` with ``ids`` and, if asked for, ``decoded``, the pieces of the ids joined."""
    small_batches(docs.sparkSession)
    table = shared_table(docs, path, text)
    out = ["ids"] + ["decoded"] * decode
    kept = [c for c in docs.columns if c not in out]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decode)
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, memo, vocabulary = Splitter(path), Memo(table.value, path), pieces(path)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                arrays, texts = [], []
                for x in batch.column(at):
                    ids = np.frombuffer(b"".join(map(memo.__getitem__, split(x.as_py() or ""))), memo.width)
                    arrays.append(ids.astype(np.int32))
                    if decode:
                        texts.append(" ".join(map(vocabulary.__getitem__, ids.tolist())))
                offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.array([], np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids, *([pa.array(texts, pa.string())] * decode)], [*kept, *out])

    return docs.select(*kept).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the pieces of its ids, looked up in the id-to-piece table that
    every task holds (the vocabulary bounds it), in order."""
    kept = [c for c in encoded.columns if c != "decoded"]
    at = kept.index(ids)
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        for batch in batches:
            texts = [" ".join(map(vocabulary.__getitem__, x.as_py() or ())) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, "decoded"])

    return encoded.select(*kept).mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode_decode(docs, path or default_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
