"""Token counts by the whole-token shortcut.

Most pre-tokens of ordinary text are vocabulary strings that byte-pair encoding leaves in one piece. Which of them are
is proved once on the driver, by running the merges on each vocabulary string. Executors then count such pre-tokens
by a set lookup and run merges only for the rest, remembering the answers.

The cut into pre-tokens is proved too: every code point up to MOST_PROVED is cut in contexts that tell letters, numbers,
spaces and other signs apart, by the library and by the pattern. Where both agree, texts of any script are cut by the
pattern; a text that holds another code point is cut by the library, and its pieces are looked up in the same way.

Defined results: ids are integers; a null or empty text has 0 bytes and 0 tokens; special strings inside a text count as the library's
default counts them, one token each; repeated rows each get a row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from mosaiq.llm.common import MOST_WORDS, arrow_map, held, spread

#: Fixed value: white space as the vocabulary's pre-tokeniser knows it (the Unicode property White_Space).
SPACE = r"\p{White_Space}"
#: Fixed value: the published pre-token pattern of the byte-level vocabulary, with the space class spelled out.
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Planes past this code point hold private use and nothing that is assigned, but for tags and variation selectors.
MOST_PROVED = 0x3FFFF


def byte_letters() -> dict[int, str]:
    """The published byte-to-letter table: printable Latin-1 bytes stand for themselves, the others follow U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table = {b: chr(b) for b in plain}
    return table | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


def prove_whole(vocabulary_json: str) -> list[str]:
    """Vocabulary strings, as text, that encode alone as one token."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(vocabulary_json)
    back = {c: b for b, c in byte_letters().items()}
    whole = []
    for piece in json.loads(vocabulary_json)["model"]["vocab"]:
        if any(c not in back for c in piece) or len(tok.model.tokenize(piece)) != 1:
            continue
        try:
            whole.append(bytes(back[c] for c in piece).decode())
        except UnicodeDecodeError:
            continue
    return whole


def unproved(library, cut) -> list[tuple[int, int]]:
    """Ranges of code points, as (first, last), that the library may cut otherwise than the pattern does."""
    back = {c: b for b, c in byte_letters().items()}

    def agree(points: range) -> bool:
        # Four classes give four cuts: a letter joins the a, a number the 1, a sign the !, a space none.
        text = "".join([f"a{c}1{c}!{c}" for c in map(chr, points)])
        theirs = [piece for piece, _ in library.pre_tokenizer.pre_tokenize_str(text)]
        return [len(x.encode()) for x in cut(text)] == [len([c for c in piece if c in back]) for piece in theirs]

    out, todo = [(MOST_PROVED + 1, 0x10FFFF)], [range(0xD800), range(0xE000, MOST_PROVED + 1)]
    while todo:
        points = todo.pop()
        if len(points) > 2048:
            todo += [points[:2048], points[2048:]]
        elif not agree(points):
            half = len(points) // 2
            if half:
                todo += [points[:half], points[half:]]
            else:
                out.append((points[0], points[0]))
    ranges: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if ranges and ranges[-1][1] + 1 == a:
            a = ranges.pop()[0]
        ranges.append((a, b))
    return ranges


def pattern_cut():
    return regex.compile(PRETOKEN).findall


class Counter(dict):
    """Pre-token -> number of tokens; proved strings are there from the start, others are merged when first met.

    `merged` counts the pre-tokens whose merges were run.
    """

    def __init__(self, whole: list[str], vocabulary_json: str, other: list[tuple[int, int]]):
        super().__init__(dict.fromkeys(whole, 1))
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary_json)
        spec = json.loads(vocabulary_json)
        kind = spec["pre_tokenizer"] or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex") or spec["normalizer"]:
            raise ValueError("the whole-token shortcut is made for byte-level vocabularies without a normaliser")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.letters, self.merged = byte_letters(), 0
        self.bytes = {c: b for b, c in self.letters.items()}
        self.cut = pattern_cut()
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in spec["added_tokens"]) or r"(?!)")
        # Most texts hold nothing past the first code point in question, which a single range tells fast.
        self.beyond = re.compile(f"[^\\x00-\\U{other[0][0] - 1:08x}]").search
        self.unproved = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in other) + "]").search

    def __missing__(self, piece: str) -> int:
        n = len(self.library.model.tokenize("".join([self.letters[b] for b in piece.encode()])))
        self.merged += 1
        if len(self) < MOST_WORDS and len(piece) <= 64:
            self[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        found = self.beyond(text)
        if not found or not self.unproved(text, found.start()):
            return self.cut(text)
        return [bytes([self.bytes[c] for c in piece]).decode() for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def tokens(self, text: str) -> int:
        parts = self.special.split(text) if self.special.search(text) else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(part))) for part in parts)


@lru_cache(maxsize=4)
def proved(vocabulary_json: str) -> tuple[list[str], list[tuple[int, int]]]:
    """(whole tokens, code points that only the library cuts). Takes seconds, on the driver, once a vocabulary."""
    from tokenizers import Tokenizer

    return prove_whole(vocabulary_json), unproved(Tokenizer.from_str(vocabulary_json), pattern_cut())


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of each row. `vocabulary` is a tokenizers .json, read on the driver."""
    source = Path(vocabulary).read_text()
    shared = docs.sparkSession.sparkContext.broadcast((source, *proved(source)))  # the vocabulary file bounds its size
    version = hashlib.sha256(source.encode()).hexdigest()

    def run(batch: pa.RecordBatch):
        tokens = held("token counter", version, lambda: Counter(shared.value[1], shared.value[0], shared.value[2])).tokens
        texts = [x or "" for x in batch.column(1).to_pylist()]
        sizes = [len(x.encode()) for x in texts]
        counts = [tokens(x) for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([x > limit for x in counts], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(spread(docs.select(id_col, text_col)), run, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean")
