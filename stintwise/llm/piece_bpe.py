"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

For every prefix of a text the last token of its encoding is unique. A table
keeps that token per prefix: an automaton over the vocabulary gives all pieces
that end at a position; the one whose pair with the last token of the prefix
before it is compatible (merging the two pieces' characters leaves exactly the
two) is the prefix's last token. The ids are then recovered backwards from the
last position.

The model's own settings are read from its file: identity normalisation, a
space put in front, spaces as U+2581, byte fallback. No piece holds U+2581
behind another character, so no merge crosses from a word into the next
space: texts are cut there and the words' encodings kept in a bounded
two-generation memo (frequent words are encoded once per worker).

Defined results: a null or empty text has no ids and decodes to an empty text;
U+2581 in a text is the same symbol as a space and decodes to one, as in the
library; very long words take time linear in their length; repeated rows are
encoded each; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")
MEMO = 120_000      # words per memo generation


class PieceBpe:
    """Encoder and decoder for one BPE model file (read by path, per worker)."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = {i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.id = {self.pieces[i]: i for i in normal}
        self.score = {self.pieces[i]: sp.get_score(i) for i in normal}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece crosses a word boundary; words cannot be encoded on their own")
        self.byte_id = {int(m[1], 16): i for i in range(n) if sp.is_byte(i) and (m := _BYTE.match(self.pieces[i]))}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        self.texts = [p.replace(SPACE, " ") for p in self.pieces]
        self.follow: dict[str, dict[str, bool]] = {}    # last token -> next piece -> compatible
        self.tested = 0
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string by best-score, leftmost merging."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best = at = None
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of both leaves exactly the two; at a
        word's start (``left`` empty) the piece must come out of its own."""
        if self.tested > 300_000:       # bounded memory; pairs are tested again
            self.follow.clear()
            self.tested = 0
        self.tested += 1
        ok = self.merged(left + right) == ([left, right] if left else [right])
        self.follow.setdefault(left, {})[right] = ok
        return ok

    def split(self, word: str) -> list[str]:
        """Pieces (or characters outside the vocabulary) of one word."""
        n, done = len(word), 0
        last = [""] * (n + 1)           # last token of each prefix
        after: list = [None] * (n + 1)  # what is known to follow it
        follow = self.follow
        for at, (piece, size) in self.automaton.iter(word):
            end = at + 1
            if last[end]:
                continue
            while done < at:            # a prefix that no piece ends: bytes, later
                done += 1
                if not last[done]:
                    last[done] = word[done - 1]
            start = end - size
            known = after[start]
            if known is None:
                known = after[start] = follow.setdefault(last[start], {})
            ok = known.get(piece)
            if ok or ok is None and self.compatible(last[start], piece):
                last[end] = piece
        while done < n:
            done += 1
            if not last[done]:
                last[done] = word[done - 1]
        out, end = [], n
        while end:
            piece = last[end]
            out.append(piece)
            end -= len(piece)
        out.reverse()
        return out

    def ids_of(self, word: str) -> list[int]:
        pieces, known = self.split(word), self.id
        try:
            return [known[p] for p in pieces]
        except KeyError:
            out: list[int] = []
            for p in pieces:
                out += [known[p]] if p in known else [self.byte_id[b] for b in p.encode()]
            return out

    def _word(self, word: str) -> tuple[int, str, str]:
        """(number of ids, the ids joined by commas, their decoded text)."""
        got = self.old.pop(word, None)
        if got is None:
            ids = self.ids_of(word)
            got = len(ids), ",".join(map(str, ids)), self.text_of(ids)
        if len(self.young) >= MEMO:
            self.old, self.young = self.young, {}
        if len(word) < 64:
            self.young[word] = got
        return got

    def words(self, text: str) -> list[str]:
        return _CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self.words(text or "") for i in self.ids_of(w)]

    def text_of(self, ids: list[int]) -> str:
        """Decoded pieces, without removing the space put in front."""
        texts, byte_of = self.texts, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            return "".join([texts[i] for i in ids])
        out, run = [], bytearray()
        for i in ids:
            b = byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            out.append(texts[i])
        if run:
            out.append(run.decode(errors="replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.text_of(ids).removeprefix(" ")

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(ids, SHA-256 of the ids, SHA-256 of the text decoded from them)."""
        words, at = self.words(text or ""), -1
        got = list(map(self.young.get, words))
        for _ in range(got.count(None)):
            at = got.index(None, at + 1)
            got[at] = self.young.get(words[at]) or self._word(words[at])
        sizes, parts, texts = zip(*got) if got else ((), (), ())
        ids = ",".join(parts)
        back = "".join(texts).removeprefix(" ")
        return (sum(sizes), hashlib.sha256(ids.encode()).hexdigest(),
                hashlib.sha256(back.encode()).hexdigest())


_LOADED: dict[str, PieceBpe] = {}


def loaded(path: str) -> PieceBpe:
    """One encoder per worker and model file."""
    if path not in _LOADED:
        _LOADED[path] = PieceBpe(path)
    return _LOADED[path]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_column(df: DataFrame, text: str, path: str, out: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text`` as an array of ints."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(path)
        for batch in batches:
            yield pd.Series([bpe.encode(t) for t in batch], dtype=object)

    return df.withColumn(out, ids(F.col(text)))


def decode_column(df: DataFrame, ids: str, path: str, out: str = "text") -> DataFrame:
    """``df`` with the text decoded from the array of ids (null: empty)."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(path)
        for batch in batches:
            yield pd.Series([bpe.decode([int(i) for i in x]) if x is not None else "" for x in batch], dtype=object)

    return df.withColumn(out, text(F.col(ids)))


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for batch in batches:
            yield pd.DataFrame([bpe.digest(t) for t in batch], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest(F.col("text")).alias("d")).select("doc_id", "d.*")


def op9_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path())
