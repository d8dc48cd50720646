"""Tokens of texts by the public tokenizers, with a memo of what short pieces give.

Both vocabularies used here cut a text into pre-tokens that never hold white space inside
(byte-level: at most as a prefix; word-level: white space is dropped). So a text may be
cut wherever white space follows a character that is not white space, and each piece
tokenized on its own: `" that,"` gives the same ids wherever it stands. A letter followed
by plain punctuation is such a cut as well. Pieces repeat, and only new ones go to the
library. Whether a vocabulary cuts texts so is read from its file; any other gets whole
texts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, buckets, kept, LOWER, stored

#: White space as the tokenizers' expressions have it (Unicode White_Space); Python's \s also has U+001C to U+001F.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_CUT = re.compile(f"[^{SPACE}](?=[{SPACE}])")
#: After an ASCII letter, a run of these is a pre-token of its own in both vocabularies.
_TAIL = ".,;:!?"


#: Punctuation of Chinese and Japanese text.
_WIDE = "\u3001\u3002\u3003\u3008\u3009\u300a\u300b\u300c\u300d\u300e\u300f\u3010\u3011\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f"
#: The expression by which the word-level vocabulary cuts its texts (a fixed value of its file).
_WORD_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cuts(lib) -> str | None:
    """How a vocabulary cuts texts before it looks at them: by bytes with the usual expression, by words, or None for any other way."""
    made = json.loads(lib.to_str())
    first, how = made["normalizer"], made["pre_tokenizer"] or {}
    if first is None and how.get("type") == "ByteLevel" and how["use_regex"] and not how["add_prefix_space"]:
        return "bytes"
    steps = how.get("pretokenizers") or [{}]
    if first and [n["type"] for n in first.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and steps[0].get("pattern") == {"Regex": _WORD_CUTS}:
        return "words"
    return None


class PieceCounts(dict):
    """Piece of a text to its number of tokens; the library is asked for pieces not seen yet."""

    def __init__(self, path: str, most: int = 1_000_000):
        super().__init__()
        self.lib, self.most = tokenizer(path), most
        self.cut = cuts(self.lib) == "bytes"

    def of(self, piece: str) -> int:
        return len(self.lib.encode(piece, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> int:
        if len(piece) > 200:
            return self.of(piece)
        if len(self) >= self.most:
            self.clear()
        core = piece.rstrip(_TAIL)
        if core != piece and core and core[-1].isascii() and core[-1].isalpha():
            n = self[core] + self[piece[len(core):]]
        else:
            n = self.of(piece)
        self[piece] = n
        return n

    def count(self, text: str) -> int:
        if not self.cut:
            return self.of(text)
        return sum(map(self.__getitem__, _PIECES.findall(text)))


_memo: dict[str, PieceCounts] = kept({})


def piece_counts(path: str) -> PieceCounts:
    """The memo of this Python worker."""
    if path not in _memo:
        _memo[path] = PieceCounts(path)
    return _memo[path]


def _stable(text: str, at: int) -> bool:
    """Whether the vocabulary's expression ends a pre-token here wherever the text is cut: white space follows another character,
    a sign (or a mark) or a digit a letter, a sign or a letter a digit. A sign before a letter may start a contraction and does not count."""
    if not 0 < at < len(text):
        return False
    if _CUT.match(text, at - 1):
        return True
    last, new = text[at - 1], text[at]
    if new.isspace():
        return False
    sign = new in _WIDE or (new.isascii() and not new.isalnum())
    if last.isalpha():
        return sign or new in "0123456789" or unicodedata.category(new)[0] == "M"
    return last in "0123456789" and (sign or (new.isascii() and new.isalpha()))


#: No special string is longer.
_SPECIAL = 32


def splice(lib, text: str, at: int, overlap: int, most: int) -> int | None:
    """The first stable boundary from `at` on that a run from before `at` and a run from `at` share; None within `most`.

    Both runs are encoded with offsets over the overlap; where they share no stable
    boundary, the overlap doubles. The last few characters don't count: a special string
    may be cut there.
    """
    while True:
        low, high = max(0, at - overlap), min(len(text), at + overlap)
        before = {low + b for _, b in lib.encode(text[low:high], add_special_tokens=False).offsets}
        after = lib.encode(text[at:high], add_special_tokens=False).offsets
        for _, b in after:
            if at + b < high - _SPECIAL and at + b in before and _stable(text, at + b):
                return at + b
        if overlap >= most:
            return None
        overlap *= 2


def count_tokens(
    docs: DataFrame, path: str, limit: int = 512, huge: int = 32_768, chunk: int = 16_384, overlap: int = 128, widest: int = 4_096
) -> DataFrame:
    """docs(doc_id, text) with n_bytes, n_tokens and over_limit (n_tokens > limit).

    Texts of over `huge` characters are cut into ranges of `chunk` characters that overlap
    by `widest` on both sides and are dealt over the cluster. Neighbours find the same
    splice from the same characters, and a range counts the tokens from its first splice
    to its last. A text in which some splice is not found within `widest` (thousands of
    letters without a break), or any text if the vocabulary cuts texts in a way not known
    here, is encoded whole. A null text is empty and has 0 tokens; repeated rows are counted each; other
    columns are dropped; no rows give no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def short():
        memo = piece_counts(path)
        return lambda texts: [[memo.count(t) for t in texts]]

    def ranged():
        lib = piece_counts(path).lib

        def one(text: str, core: int, first: bool, last: bool) -> int | None:
            start = 0 if first else splice(lib, text, core, overlap, widest)
            end = len(text) if last else splice(lib, text, core + chunk, overlap, widest)
            if start is None or end is None:
                return None
            return len(lib.encode(text[start:end], add_special_tokens=False).ids)

        return lambda *columns: [[one(*x) for x in zip(*columns, strict=True)]]

    if cuts(tokenizer(path)) != "bytes":
        huge = 2_147_483_647
    sized = rows.withColumns({"n_bytes": F.octet_length("text").cast("long"), "n": F.length("text")})
    few = append(sized.where(F.col("n") <= huge).drop("n"), ["text"], "n_tokens long", short, ("text",))
    key = sized.where(F.col("n") > huge).withColumn("print", F.sha2("text", 256))
    many = (
        key.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(chunk))))
        .withColumn("low", F.greatest(F.col("at") - widest, F.lit(0)))
        .select(
            "doc_id", "print", "n_bytes", (F.col("at") - F.col("low")).alias("core"), (F.col("at") == 0).alias("first"),
            (F.col("at") + chunk >= F.col("n")).alias("last"),
            F.when(F.col("at") + chunk >= F.col("n"), F.expr("substring(text, low + 1)")).otherwise(F.expr(f"substring(text, low + 1, at - low + {chunk + widest})")).alias("text"),
        )
        .repartition(buckets(docs.sparkSession), "print", "core", F.xxhash64("text"))
    )
    counted = stored(
        append(many, ["text", "core", "first", "last"], "n_tokens long", ranged, ("text", "core", "last"))
        .groupBy("doc_id", "print").agg(
            F.first("n_bytes").alias("n_bytes"), F.count_if("first").alias("copies"),
            F.sum("n_tokens").alias("n_tokens"), F.count_if(F.col("n_tokens").isNull()).alias("failed"),
        ),
        "token-ranges",
    )
    done = (
        counted.where("failed = 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("doc_id", "n_bytes", F.expr("n_tokens div copies").alias("n_tokens"))
    )
    found = few.unionByName(done)
    again = counted.where("failed > 0").select("doc_id", "print")
    if not again.isEmpty():
        whole = key.join(again, key["doc_id"].eqNullSafe(again["doc_id"]) & (key["print"] == again["print"]), "left_semi")
        found = found.unionByName(append(whole.drop("print", "n"), ["text"], "n_tokens long", short, ("text",)))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


class WordIds(dict):
    """Lower-cased word (bytes) to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most: int = 800_000):
        super().__init__()
        self.lib, self.most = tokenizer(path), most
        self.cut = cuts(self.lib) == "words"

    def of(self, word: bytes) -> bytes:
        return np.array(self.lib.encode(word.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > 200:
            return self.of(word)
        if len(self) >= self.most:
            self.clear()
        core = word.rstrip(_TAIL.encode())
        if core != word and core and 97 <= core[-1] <= 122:
            ids = self[core] + self[word[len(core):]]
        else:
            ids = self.of(word)
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        raw = text.encode()
        if not self.cut:
            return self.of(raw)
        if b"<|" not in raw:  # special strings are matched in their own case
            raw = raw.translate(LOWER)
        return b"".join(map(self.__getitem__, raw.split()))


_words: dict[str, WordIds] = kept({})


def word_ids(path: str, most: int = 800_000) -> WordIds:
    """The memo of this Python worker, of at most so many words (some 150 bytes each), for vocabularies that drop white space and case."""
    if path not in _words:
        _words[path] = WordIds(path)
    _words[path].most = most
    return _words[path]
