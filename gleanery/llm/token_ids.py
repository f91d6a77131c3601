"""Token ids of whole texts, by the ``tokenizers`` library.

``word_bpe`` vocabularies drop white space before they merge, so no token crosses it
and a text's ids are its words' ids end to end. Each distinct word of a block is therefore
encoded once; the words met most recently stay known to the worker.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gleanery.llm.common import hash_words, split_words
from gleanery.llm.text_stats import word_codes

END = 2
#: Words a worker remembers from one block to the next.
KNOWN_WORDS = 800_000
#: Letters and digits that composing and lower-casing leave one letter or digit: ASCII's and those of European alphabets.
ONE_LETTER = r"0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}\x{391}-\x{3A1}\x{3A3}-\x{3A9}\x{3B1}-\x{3C9}\x{410}-\x{44F}"
#: Words sent to the tokenizer as one text.
JOINED = 256


class TokenIds:
    """Ids of texts, each with the end id behind it.

    Known words are held by a 64-bit hash: among that many words the chance that any two
    share one is below one in ten million.
    """

    def __init__(self, tokenizer_path: str, end: int = END) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        self.vocabulary = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self.id_type = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        # Words may be lower-cased first, which makes more of them equal, if the tokenizer does so anyway.
        normalizer = json.loads(self._tokenizer.to_str())["normalizer"] or {}
        self._folds = "Lowercase" in {n["type"] for n in normalizer.get("normalizers", [normalizer]) if n}
        self._closing = np.zeros(self.vocabulary, bool)
        for token, number in self._tokenizer.get_vocab(with_added_tokens=True).items():
            self._closing[number] = token.endswith("</w>")
        self._end = end
        self._forget()

    @classmethod
    def shared(cls, tokenizer_path: str, end: int = END) -> TokenIds:
        """One for each Python worker, so that the words of earlier tasks stay known."""
        import tokenizers

        held = tokenizers.__dict__.setdefault("_token_ids_by_path", {})
        if (tokenizer_path, end) not in held:
            held[tokenizer_path, end] = cls(tokenizer_path, end)
        return held[tokenizer_path, end]

    def _encoded(self, texts: list[str]):
        return self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _forget(self) -> None:
        self._keys = np.zeros(0, np.uint64)
        self._first = np.zeros(0, np.int64)
        self._length = np.zeros(0, np.int64)
        self._pool = np.zeros(0, self.id_type)

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self._encoded(words)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter((i for ids in encoded for i in ids), self.id_type, lengths.sum()), lengths

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of lower-case letters only: many in one text, told apart by the ids that end a word."""
        if not self._closing.any():
            return self._one_by_one(words)
        texts = [" ".join(words[i:i + JOINED]) for i in range(0, len(words), JOINED)]
        encoded = [np.array(e.ids, self.id_type) for e in self._encoded(texts)]
        ids = np.concatenate(encoded) if encoded else np.zeros(0, self.id_type)
        ends = np.flatnonzero(self._closing[ids]) + 1
        if len(ends) != len(words):
            return self._one_by_one(words)
        return ids, np.diff(ends, prepend=0)

    def _learn(self, words: pa.Array, keys: np.ndarray) -> None:
        plain = pc.match_substring_regex(words, r"^\p{Ll}+$").to_numpy(zero_copy_only=False)
        for chosen, encode in ((plain, self._joined), (~plain, self._one_by_one)):
            if not chosen.any():
                continue
            ids, lengths = encode(words.filter(pa.array(chosen)).to_pylist())
            order = np.argsort(keys[chosen])
            new = keys[chosen][order]
            at = np.searchsorted(self._keys, new)
            self._first = np.insert(self._first, at, (len(self._pool) + np.cumsum(lengths) - lengths)[order])
            self._length = np.insert(self._length, at, lengths[order])
            self._keys = np.insert(self._keys, at, new)
            self._pool = np.concatenate([self._pool, ids])

    def _entries(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids, in the pool, of each of some distinct words."""
        keys = hash_words(words)
        known = self._find(keys) >= 0
        if len(self._keys) + np.count_nonzero(~known) > KNOWN_WORDS:
            self._forget()
            known[:] = False
        if not known.all():
            self._learn(words.filter(pa.array(~known)), keys[~known])
        at = self._find(keys)
        return self._first[at], self._length[at]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self._keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, at, -1)

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and each one's number of ids.

        A full stop or comma behind a letter or digit is a token of its own; without it fewer words differ.
        Only letters that stay one letter when the tokenizer normalises them may be cut off so: others can
        end in a mark, which it joins with the stop. A word that is not cut is encoded whole.
        """
        stops = [pc.and_(pc.ends_with(words, stop), pc.match_substring_regex(words, f"[{ONE_LETTER}].$")) for stop in ".,"]
        stop = np.select([s.to_numpy(zero_copy_only=False) for s in stops], [1, 2], 0)
        bare = pc.if_else(pa.array(stop > 0), pc.utf8_slice_codeunits(words, 0, -1), words)
        encoded = pa.concat_arrays([bare, pa.array([".", ","], bare.type)]).dictionary_encode()
        codes = encoded.indices.to_numpy()
        first, length = self._entries(encoded.dictionary)
        rows = np.column_stack([codes[:-2], np.choose(stop, [0, codes[-2], codes[-1]])]).ravel()
        sizes = length[rows].reshape(-1, 2)
        sizes[stop == 0, 1] = 0
        return gathered(self._pool, first[rows], sizes.ravel()), sizes.sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts end to end, and each text's number of ids. A null text is empty."""
        # Special tokens are spelt exactly, so texts that may hold one keep their letters.
        marked = pc.any(pc.match_substring(texts, "<|")).as_py()
        words, counts = split_words(texts, lower=self._folds and not marked)
        codes, dictionary = word_codes(words)
        ids, lengths = self._word_ids(dictionary)
        # The end id is one more word, behind each text's words.
        ids, lengths = np.append(ids, self.id_type.type(self._end)), np.append(lengths, 1)
        row = np.full(len(codes) + len(counts), len(lengths) - 1)
        row[np.arange(len(codes)) + np.repeat(np.arange(len(counts)), counts)] = codes
        each = lengths[row]
        ends = np.cumsum(each)[np.cumsum(counts + 1) - 1] if len(counts) else np.zeros(0, np.int64)
        return gathered(ids, (np.cumsum(lengths) - lengths)[row], each), np.diff(ends, prepend=0)


def gathered(pool: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of a pool, given by first place and length, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(first - (ends - lengths), lengths) + np.arange(total)]
