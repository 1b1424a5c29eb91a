"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of many words lie in one flat numpy array. Each round looks up the rank of every neighbouring pair,
takes the least rank in each word (a segmented minimum), merges all leftmost non-overlapping pairs of that rank at
once and compacts the array, until no word has a pair left. Words are what lies between word starts: no piece of
the model reaches over one, which is checked when the model is read.

A merge of several places at once equals the library's one-by-one order unless a merged piece can at once join
a piece of equal or better rank. Such pieces are found when the model is read; of them a round merges only the
leftmost place in each word.

A null text is encoded as the empty text. Texts of any length work, one text at a time and in memory in proportion to it;
repeated rows and ids are encoded row by row; a null doc_id is carried through; pairs of equal rank merge from left to right; extra
columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, mapped, table

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Words that a worker remembers between chunks; beyond it starts anew.
MEMORY = 300_000
_NONE = np.iinfo(np.int64).max
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Pieces:
    """The tables of a model: its pieces, the rank of each pair of symbols, the ids of single characters."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        names = [model.id_to_piece(i) for i in range(n)]
        scores = [model.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.ids = {names[i]: i for i in plain}
        byte = {names[i]: i for i in range(n) if model.is_byte(i)}
        self.byte_ids = [byte[f"<0x{b:02X}>"] for b in range(256)] if byte else None
        # Ranks: equal scores have equal ranks, the best is 0.
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in plain}, reverse=True))}
        self.rank = np.full(n + 1, _NONE, np.int64)
        for i in plain:
            self.rank[i] = order[scores[i]]
        self.n = n
        # Symbols are ids of pieces; characters that are no piece get the id n, which joins nothing.
        left, right, made = [], [], []
        for name, i in self.ids.items():
            for cut in range(1, len(name)):
                if (a := self.ids.get(name[:cut])) is not None and (b := self.ids.get(name[cut:])) is not None:
                    left.append(a), right.append(b), made.append(i)
        keys = np.array(left, np.int64) * (n + 1) + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(made, np.int64)[order]
        # Pieces that can join, once made, a piece of equal or better rank.
        self.single = np.zeros(n + 1, bool)
        for a, b, i in zip(left, right, made):
            for part in (a, b):
                self.single[part] |= len(names[part]) > 1 and self.rank[i] <= self.rank[part]
        self._check(names, plain)
        self.names = np.array([names[i].replace(SPACE, " ") for i in range(n)], object)
        self.is_byte = np.zeros(n, bool)
        if self.byte_ids:
            self.is_byte[self.byte_ids] = True
        self.value = np.zeros(n, np.int64)
        for b, i in enumerate(self.byte_ids or []):
            self.value[i] = b
        for i in {self.bos, self.eos}:
            self.names[i] = ""

    def _check(self, names: list[str], plain: list[int]) -> None:
        for i in plain:
            inner = names[i].lstrip(SPACE) if names[i].startswith(SPACE) else names[i]
            if SPACE in inner or (len(names[i]) > 1 and "\n" in names[i]) or (names[i].startswith(SPACE * 2) and inner):
                raise ValueError(f"piece {names[i]!r} reaches over a word start")

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the piece that each pair makes, n if none."""
        key = a * (self.n + 1) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], self.n)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, flat, and the end of each word in them."""
        flat = "".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        get, n = self.ids.get, self.n
        sym = np.fromiter((get(c, n) for c in flat), np.int64, len(flat))
        char = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(flat))  # of the first character; keeps the order of finished symbols
        done_sym, done_char, done_word, done_place = [], [], [], []
        pair = self.join(sym[:-1], sym[1:])
        pair[word[:-1] != word[1:]] = n
        while len(sym):
            ranks = np.append(self.rank[pair], _NONE)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            open_ = least < _NONE
            if not open_.all():  # words without a pair are done
                stay = np.repeat(open_, sizes)
                for done, now in ((done_sym, sym), (done_char, char), (done_word, word), (done_place, place)):
                    done.append(now[~stay])
                if not stay.any():
                    break
                sym, char, word, place, ranks = sym[stay], char[stay], word[stay], place[stay], ranks[stay]
                pair = np.append(pair, n)[stay]
                least, sizes = least[open_], sizes[open_]
            else:
                pair = np.append(pair, n)
            hit = ranks == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            # In a run of neighbouring hits every second one is merged; of single pieces only a word's first.
            new_run = np.append(True, (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]]))
            first = np.flatnonzero(new_run)
            run = np.repeat(at[first], np.diff(np.append(first, len(at))))
            take = (at - run) % 2 == 0
            alone = self.single[pair[at]]
            if alone.any():
                take &= ~alone | np.append(True, word[at[1:]] != word[at[:-1]])
            at = at[take]
            sym[at] = pair[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            sym, char, word, place, pair, changed = sym[keep], char[keep], word[keep], place[keep], pair[keep], changed[keep]
            # Only pairs beside a merged symbol are looked up again.
            again = changed.copy()
            again[:-1] |= changed[1:]
            again[-1] = False
            i = np.flatnonzero(again)
            pair[i] = np.where(word[i] == word[i + 1], self.join(sym[i], sym[i + 1]), n)
            pair = pair[:-1]
        if done_sym:
            sym, char, word, place = (np.concatenate(x) for x in (done_sym, done_char, done_word, done_place))
            order = np.argsort(place)
            sym, char, word = sym[order], char[order], word[order]
        return self.with_bytes(sym, char, word, len(words))

    def with_bytes(self, sym: np.ndarray, char: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become their UTF-8 bytes, or the unknown id."""
        counts = np.bincount(word, minlength=n_words)
        odd = np.flatnonzero(sym == self.n)
        if not len(odd):
            return sym, np.cumsum(counts)
        if self.byte_ids is None:
            sym[odd] = self.unk
            return sym, np.cumsum(counts)
        parts, last = [], 0
        for i in odd.tolist():
            raw = chr(char[i]).encode("utf-8", "replace")
            parts += [sym[last:i], np.array([self.byte_ids[b] for b in raw])]
            counts[word[i]] += len(raw) - 1
            last = i + 1
        return np.concatenate([*parts, sym[last:]]), np.cumsum(counts)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, word starts as spaces, one leading space off, bytes as UTF-8."""
        text: list[str] = self.names[ids].tolist()
        odd = np.flatnonzero(self.is_byte[ids])
        if len(odd):
            for part in np.split(odd, np.flatnonzero(np.diff(odd) != 1) + 1):
                text[part[0]] = utf8(bytes(self.value[ids[part]].tolist()))
                for i in part[1:].tolist():
                    text[i] = ""
        out = "".join(text)
        first = ids[(ids != self.bos) & (ids != self.eos)][:1]
        return out[1:] if len(first) and not self.is_byte[first[0]] and out.startswith(" ") else out


def utf8(raw: bytes) -> str:
    """Bytes as text, one replacement character for each byte that isn't part of a valid one."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                n = 1
            i += n
        return "".join(out)


_WORDS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Encoder:
    """Encodes chunks of texts. Words met before are remembered as slices of one flat array of ids."""

    def __init__(self, path: str) -> None:
        self.pieces = pieces(path)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.flat, self.ends = np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with begin and end."""
        if len(self.ends) > MEMORY:
            self.forget()
        get = self.number.__getitem__
        found = [np.fromiter(map(get, _WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else ()), np.int64) for t in texts]
        if new := list(islice(self.number, len(self.ends), None)):
            flat, ends = self.pieces.merge(new)
            self.ends = np.concatenate([self.ends, ends + len(self.flat)])
            self.flat = np.concatenate([self.flat, flat])
        begins = np.append(0, self.ends[:-1])
        out = []
        for at in found:
            lengths = self.ends[at] - begins[at]
            total = int(lengths.sum())
            where = np.repeat(begins[at] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(total) if total else np.empty(0, np.int64)
            ids = np.empty(total + 2, np.int64)
            ids[0], ids[-1] = self.pieces.bos, self.pieces.eos
            ids[1:-1] = self.flat[where]
            out.append(ids)
        return out


def encode_texts(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): the number of ids, a digest of them and of the decoded text; if asked, the ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        encoder = Encoder(path)
        for batch in chunks(batches):
            ids = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            yield [
                batch.column(0),
                [len(x) for x in ids],
                [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
                [hashlib.sha256(encoder.pieces.decode(x).encode("utf-8", "replace")).hexdigest() for x in ids],
                *([[x.astype(np.int32) for x in ids]] if with_ids else []),
            ]

    return mapped(docs.select("doc_id", "text"), work, SCHEMA + (", ids array<int>" if with_ids else ""))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
