"""Whole texts to token ids with the tokenizers library, encoding each different word once.

Texts are cut at ASCII white space. The tokenizers this is for drop white space and never let a
token cross it, so a text's ids are its words' ids in a row. Words are remembered in the worker,
``MOST_WORDS`` at a time. Words of ASCII and Latin-1 letters, and those with one mark at the end, go in
lower case straight to the tokenizer's model, if the steps before it do no more to them. Other words with
Latin letters and simple marks only are encoded many to a call, because a call for each is slow; their
ids are told apart by the marks of word ends.
"""

from __future__ import annotations

import importlib
import os
import re
import sys
import types

import numpy as np

#: Words that a worker remembers; when there are more, it starts anew.
MOST_WORDS = 900_000
#: Words encoded with one call.
CALL = 512
TOKENIZER = "word_bpe_49k.json"
#: What one token can't cross in a word of ASCII and Latin-1 letters, digits and marks, lower-cased.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
MARKS = b".,;:!?|"
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def default_tokenizer() -> str:
    return importlib.import_module("public_tokenizers").path(TOKENIZER)


def worker_memo() -> types.ModuleType:
    """A place for what a Python worker keeps from task to task."""
    return sys.modules.setdefault("_corpus_worker_memo", types.ModuleType("_corpus_worker_memo"))


class Words(dict):
    """Numbers words; the ids of word k are ``flat[starts[k]:starts[k] + sizes[k]]``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        marks = {c: self._encode([chr(c)])[0] for c in MARKS}
        self.marks = {c: ids[0] for c, ids in marks.items() if len(ids) == 1}
        self.straight = self._leaves_letters()
        self.fresh: list[bytes] = []
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.fresh.clear()
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _leaves_letters(self) -> bool:
        """Whether a word of letters comes to the model whole, in lower case, and leaves it as its ids.

        ``spelt`` is then how the model's vocabulary spells each letter.
        """
        tokenizer, added = self.tokenizer, self.tokenizer.get_added_tokens_decoder().values()
        if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None or tokenizer.post_processor is not None:
            return False
        if tokenizer.truncation or tokenizer.padding or any(t.content.isalpha() for t in added):
            return False
        self.spelt = {}
        for letter in LETTERS:
            pieces = tokenizer.pre_tokenizer.pre_tokenize_str(letter)
            if len(pieces) != 1:
                return False
            self.spelt[ord(letter)] = pieces[0][0]
        for word in (*LETTERS, *(a + b for a in LETTERS for b in LETTERS), LETTERS, LETTERS[::-1]):
            upper = "".join(c if c in "ßÿ" else c.upper() for c in word)  # those two have none in Latin-1
            if any(tokenizer.normalizer.normalize_str(w) != word for w in (word, upper)):
                return False
            if [piece for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(word)] != [word.translate(self.spelt)]:
                return False
        return True

    def _of_letters(self, words: list[int], texts: list[str], tails: list[int]) -> tuple:
        """``(words, ids of all of them, sizes)`` of words of letters, each perhaps with the id of a mark after it."""
        tokenize, flat, sizes = self.tokenizer.model.tokenize, [], []
        for text, tail in zip(texts, tails, strict=True):
            ids = [token.id for token in tokenize(text)]
            if tail >= 0:
                ids.append(tail)
            flat += ids
            sizes.append(len(ids))
        return words, np.array(flat, np.uint32), np.array(sizes, np.int64)

    def learn(self) -> None:
        """Encode the words seen since the last call."""
        if not self.fresh:
            return
        known = len(self.starts)
        plain, pieces, other, like, bases, tails = [], [], [], [], [], []
        letters, texts, ends = [], [], []
        for number, word in enumerate(self.fresh, known):
            if word.isalpha():  # ASCII letters
                low = word.lower()
                base = self.get(low, number)
                if base != number:  # the same but for A-Z
                    like.append(number)
                    bases.append(base)
                    tails.append(-1)
                elif self.straight:
                    letters.append(number)
                    texts.append(low.decode())
                    ends.append(-1)
                else:
                    plain.append(number)
                    pieces.append(1)
                continue
            if (tail := self.marks.get(word[-1], -1)) >= 0 and word[:-1].isalpha():
                low = word[:-1].lower()
                base = self.get(low, -1)
                if base >= 0:
                    like.append(number)
                    bases.append(base)
                    tails.append(tail)
                elif self.straight:
                    letters.append(number)
                    texts.append(low.decode())
                    ends.append(tail)
                else:
                    plain.append(number)
                    pieces.append(2)
                continue
            text = word.decode()
            body = text[:-1] if tail >= 0 else text
            if self.straight and LATIN.fullmatch(body):
                letters.append(number)
                texts.append(body.lower().translate(self.spelt))
                ends.append(tail)
                continue
            if PLAIN.fullmatch(text) and "<|" not in text:
                plain.append(number)
                pieces.append(len(PIECE.findall(text.lower())))
            else:
                other.append(number)
        found = [*self._joined(plain, pieces, known), self._of_letters(letters, texts, ends)]
        self._place(known, [*found, (other, self._encode([self.fresh[k - known].decode() for k in other]))])
        self._extend(np.array(like, np.int64), np.array(bases, np.int64), np.array(tails, np.int64))
        self.fresh.clear()

    def _joined(self, words: list[int], pieces: list[int], known: int) -> list[tuple]:
        """``(words, ids of all of them, sizes)`` of plain words, encoded ``CALL`` at a time."""
        calls = [words[at : at + CALL] for at in range(0, len(words), CALL)]
        found = []
        encoded = self._encode([" ".join([self.fresh[k - known].decode() for k in call]) for call in calls])
        for at, (call, ids) in enumerate(zip(calls, encoded, strict=True)):
            ids = np.asarray(ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            lasts = np.cumsum(pieces[at * CALL : at * CALL + len(call)])
            if lasts[-1] == len(stops):
                found.append((call, ids, np.diff(stops[lasts - 1], prepend=0)))
            else:  # a word had other pieces than thought
                found.append((call, self._encode([self.fresh[k - known].decode() for k in call])))
        return found

    def _place(self, known: int, found: list[tuple]) -> None:
        grown = known + len(self.fresh)
        self.starts, self.sizes = (np.concatenate([a, np.zeros(grown - known, np.int64)]) for a in (self.starts, self.sizes))
        flats, at = [self.flat], len(self.flat)
        for words, ids, *sizes in found:
            if not words:
                continue
            size = sizes[0] if sizes else np.fromiter(map(len, ids), np.int64, len(ids))
            flats.append(ids if sizes else np.concatenate([np.asarray(x, np.uint32) for x in ids]))
            self.sizes[words] = size
            self.starts[words] = at + np.cumsum(size) - size
            at += len(flats[-1])
        self.flat = np.concatenate(flats)

    def _extend(self, words: np.ndarray, bases: np.ndarray, tails: np.ndarray) -> None:
        """Words that are another one in lower case, perhaps with one more mark at the end."""
        if not len(words):
            return
        marked = tails >= 0
        self.sizes[words] = self.sizes[bases] + marked
        sizes = self.sizes[words]
        stops = np.cumsum(sizes)
        out = np.empty(int(stops[-1]), np.uint32)
        own = sizes - marked
        row = np.repeat(np.arange(len(words)), own)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
        out[(stops - sizes)[row] + nth] = self.flat[self.starts[bases][row] + nth]
        out[stops[marked] - 1] = tails[marked]
        self.starts[words] = len(self.flat) + stops - sizes
        self.flat = np.concatenate([self.flat, out])


class Encoder:
    """``encode(texts)``: for each text its ids and then ``end``; only ``end`` for null."""

    def __init__(self, path: str, end: int):
        memo = worker_memo()
        if getattr(memo, "path", None) != path:
            memo.path, memo.words = path, Words(path)
        self.words, self.end = memo.words, end

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        words = self.words
        if len(words) > MOST_WORDS:
            words.reset()
        numbers = []
        for text in texts:
            own = text.split() if text else []
            numbers.append(np.fromiter(map(words.__getitem__, own), np.int64, len(own)))
        words.learn()
        return [self._ids(n) for n in numbers]

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.words.sizes[numbers]
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        out = np.empty(total + 1, np.uint32)
        if total:
            shift = np.repeat(self.words.starts[numbers] - (stops - sizes), sizes)
            out[:-1] = self.words.flat[shift + np.arange(total)]
        out[-1] = self.end
        return out
