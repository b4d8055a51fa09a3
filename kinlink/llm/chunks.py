"""Token ids of batches of whole texts, each different word encoded once.

The patterns that split text before BPE never match across a single blank or
newline that stands between two other characters, except that a blank joins
the word it precedes.  So most texts can be cut at blanks and newlines; the
words of a batch become a dictionary, its entries are encoded, and the ids are
laid out by the dictionary's indices.  Texts with other white space, or a run
of it, take the exact pattern by themselves.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Words of one generation of a memo, the longest one it keeps, and the text
#: characters of a batch.
MEMO_ENTRIES, MEMO_CHARS, BATCH_CHARS = 200_000, 48, 8 << 20
#: White space but for single blanks and newlines inside a text, and NUL.
ODD = r"[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
FIRST = "\r"  # marks the first word of a text
#: A full stop or comma between a letter and a cut is a match of its own.
STOP = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([.,])(\x00|\z)"


def ragged(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[starts[k] : starts[k] + counts[k]] for every k, one after the other."""
    ends = np.cumsum(counts)
    return values[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` in all, at least one row each."""
    a = held = 0
    for k, n in enumerate(sizes):
        if k > a and held + n > most:
            yield a, k
            a, held = k, 0
        held += n
    if a < len(sizes):
        yield a, len(sizes)


class Memo:
    """Ids of words by a function of one word; two generations bound its size."""

    def __init__(self, compute: Callable[[str], tuple[int, ...]], entries: int = MEMO_ENTRIES):
        self.compute, self.entries, self.now, self.old = compute, entries, {}, {}

    def __getitem__(self, key: str) -> tuple[int, ...]:
        value = self.now.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.compute(key)
            if len(key) <= MEMO_CHARS:
                if len(self.now) >= self.entries:
                    self.old, self.now = self.now, {}
                self.now[key] = value
        return value

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(self.__getitem__, words.to_pylist()))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts


class BatchEncoder:
    """distinct: (flat ids, counts) of an array of different words; odd: ids of
    a text that isn't cut; marks: words carry what stands before them (FIRST,
    a blank or a newline), else white space has no ids; fold: a text of the
    same ids with fewer different words, or None to treat it as odd."""

    def __init__(self, distinct, odd: Callable[[str], Iterable[int]], marks: bool = True, fold: Callable[[str], str | None] | None = None):
        self.distinct, self.odd, self.marks, self.fold = distinct, odd, marks, fold

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each text)."""
        folded = texts if self.fold is None else list(map(self.fold, texts))
        column = pa.array(folded, pa.large_string())
        odd = pc.fill_null(pc.match_substring_regex(column, ODD), True).to_numpy(zero_copy_only=False)
        plain = ~odd & (pc.fill_null(pc.binary_length(column), 0).to_numpy() > 0)
        column = column.filter(pa.array(plain))
        if self.marks:
            column = pc.replace_substring(pc.replace_substring(column, " ", "\x00 "), "\n", "\x00\n")
            column = pc.binary_join_element_wise(pa.scalar(FIRST, pa.large_string()), column, pa.scalar("", pa.large_string()))
        else:
            column = pc.replace_substring(pc.replace_substring(column, "\n", "\x00"), " ", "\x00")
        column = pc.replace_substring_regex(column, STOP, "\\1\x00\\2\\3")
        lists = pc.split_pattern(column, "\x00")
        words = pc.list_flatten(lists).dictionary_encode()
        ids, counts = self.distinct(words.dictionary)
        starts, at = np.cumsum(counts) - counts, words.indices.to_numpy()
        flat = ragged(ids, starts[at], counts[at])
        upto = np.concatenate([[0], np.cumsum(counts[at])])
        of_text = np.zeros(len(texts), np.int64)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        of_text[plain] = np.diff(upto[ends], prepend=0)
        if odd.any():
            parts, a = [], 0
            for k, n in enumerate(of_text.tolist()):
                part = np.fromiter(self.odd(texts[k]), np.int32) if odd[k] else flat[a : a + n]
                a += n
                of_text[k] = len(part)
                parts.append(part)
            flat = np.concatenate(parts)
        return flat, of_text

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()


def batched(encoder: BatchEncoder, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, flat ids, counts) of runs of about BATCH_CHARS characters; null is empty."""
    full = [t or "" for t in texts]
    for a, b in slices(list(map(len, full)), BATCH_CHARS):
        yield a, b, *encoder.encode_batch(full[a:b])


def byte_symbols() -> dict[int, str]:
    """Byte-level BPE's printable character of every byte: printable Latin-1
    stands for itself, the rest for the characters from U+0100 in byte order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


SYMBOLS = byte_symbols()


def pieces_of(pattern, word: str) -> tuple[str, ...]:
    """The matches of ``pattern`` in a marked word, with the newline before it."""
    if word[0] == " ":
        if word[1:].isalpha():  # one match with the blank
            return (word,)
        return tuple(pattern.findall(word))
    if word[0] in ".,":
        return (word,)
    rest = word[1:]
    found = (rest,) if rest.isalpha() else tuple(pattern.findall(rest))
    return found if word[0] == FIRST else ("\n", *found)


def byte_level_encoder(tok, pattern) -> BatchEncoder:
    """A BatchEncoder over a byte-level tokenizers.Tokenizer that splits by
    ``pattern``; its model gets each match in byte symbols."""
    model = tok.model

    def piece(text: str) -> list[int]:
        return [t.id for t in model.tokenize(text.encode().decode("latin-1").translate(SYMBOLS))]

    blank = SYMBOLS[32]

    def word(text: str) -> tuple[int, ...]:
        if text[0] == " " and text.isascii() and text[1:].isalpha():
            return tuple([t.id for t in model.tokenize(blank + text[1:])])
        return tuple(chain.from_iterable(map(piece, pieces_of(pattern, text))))

    return BatchEncoder(Memo(word), lambda text: chain.from_iterable(map(piece, pattern.findall(text))))


def lowered(text: str) -> str | None:
    """The lower-case text where that is the same for whole texts and single
    characters, and canonical composition changes neither; else None."""
    low = text.lower()
    if text.isascii() or ("Σ" not in text and "İ" not in text and is_normalized("NFC", text) and is_normalized("NFC", low)):
        return low
    return None


def word_encoder(tok) -> BatchEncoder:
    """A BatchEncoder over a tokenizers.Tokenizer that composes, lower-cases,
    discards white space and never joins a letter to a full stop or comma."""
    model = tok.model
    splits = [p["pattern"]["Regex"] for p in json.loads(tok.to_str())["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
    pattern = regex.compile(splits[0])

    def whole(text: str) -> list[int]:
        return tok.encode(text, add_special_tokens=False).ids

    def match(text: str) -> list[int]:
        plain = text.isascii() and text.isalnum()  # control characters aren't their own symbols
        return [t.id for t in model.tokenize(text if plain else text.encode().decode("latin-1").translate(SYMBOLS))]

    def word(text: str) -> tuple[int, ...]:
        if text.isalpha():
            return tuple(match(text))
        return tuple(chain.from_iterable(map(match, pattern.findall(text))))

    return BatchEncoder(Memo(word), whole, marks=False, fold=lowered)
