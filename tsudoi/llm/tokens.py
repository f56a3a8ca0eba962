"""Token ids of whole texts by the ``tokenizers`` library, with a bounded cache of chunk encodings per worker.

Both supported pre-tokenizers cut at white space, so a text is the concatenation of independently encoded chunks. Arrow
cuts the texts of a batch and numbers their distinct chunks; each of those is looked up once, only unseen ones go to the
library, and ids are gathered by number. A text for which this isn't certain (unusual white space, runs of it,
special-token strings) and every text of an unknown pre-tokenizer is encoded as one piece.
"""
from __future__ import annotations

import json
import os
from array import array
from itertools import filterfalse, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_ENTRIES = 800_000
# White space by any definition other than space and newline, and the start of special tokens; then runs of the two.
ODD = r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|"
RUNS = r"[ \n][ \n]"
# Marks that, as the whole end of a chunk, are cut off the letter before them by both pre-tokenizers.
LETTERS_ALONE = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder:
    """ids(texts) -> one little-endian uint32 array for each text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.mode, self.model = chunking(spec), self.library.model
        self.cache: dict[str, bytes] = {}
        self.edges = np.zeros(self.library.get_vocab_size() + 1, bool)  # tokens that end (drop) or begin (keep) a word
        for token, i in self.library.get_vocab().items():
            if token.endswith("</w>") if self.mode == "drop" else token.startswith("Ġ"):
                self.edges[i] = True

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """A null text counts as empty."""
        return [np.frombuffer(b, "<u4") for b in self.raw(texts)]

    def raw(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        if len(self.cache) > CACHE_ENTRIES:  # the chunks seen first are the frequent ones, so the later half goes
            self.cache = dict(islice(self.cache.items(), CACHE_ENTRIES // 2))
        column = pa.array(texts, pa.large_string()).fill_null("")
        whole = self.uncut(column)
        for i, ids in zip(np.flatnonzero(whole).tolist(), self.encode([texts[i] for i in np.flatnonzero(whole)])):
            out[i] = ids
        split = self.chunks(column.filter(pa.array(~whole)))
        numbered = split.flatten().dictionary_encode()
        keys = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.cache.get, keys))
        learnt = iter(self.learn([k for k, ids in zip(keys, known) if ids is None]))
        known = [next(learnt) if ids is None else ids for ids in known]
        ids = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first, chunk = np.cumsum(size) - size, numbered.indices.to_numpy()
        n = size[chunk]
        end = np.concatenate(([0], np.cumsum(n)))
        raw = ids[np.repeat(first[chunk] - end[:-1], n) + np.arange(end[-1])].tobytes()
        cuts = 4 * end[split.offsets.to_numpy() - split.offsets[0].as_py()]
        for i, a, b in zip(np.flatnonzero(~whole).tolist(), cuts.tolist(), cuts[1:].tolist()):
            out[i] = raw[a:b]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, keys: list[str]) -> list[bytes]:
        """The ids of unseen keys. Marks that end a key after a letter are encoded apart from it, so such a key is put together
        from two others, and only those are kept."""
        heads, tails, cache = [], [], self.cache
        for k in keys:
            stem = k.rstrip(MARKS)
            last = stem[-1:]
            # letters of Latin, Greek and Cyrillic stay letters in any normal form, but for one whose lower case ends in a mark
            if not (len(stem) < len(k) and last.isalpha() and last < "\u0530" and last != "\u0130"):
                stem = k
            heads.append(stem)
            tails.append(self.inner(k[len(stem):]))
        todo = [k for k in {*heads, *tails} if k not in cache]
        words, rest = list(filter(str.isalpha, todo)), list(filterfalse(str.isalpha, todo))
        plain = list(filter(str.isascii, words))
        words = list(filterfalse(str.isascii, words))
        cache.update(zip(plain, map(self.plain, plain)))
        cache.update(zip(rest, self.encode([self.text_of(k) for k in rest])))
        for at in range(0, len(words), 500):
            self.learn_words(words[at:at + 500])
        return [cache[a] + cache[b] for a, b in zip(heads, tails)]

    def plain(self, word: str) -> bytes:
        """A word of ASCII letters needs no normal form and is its own bytes, so the model alone reads it."""
        found = self.model.tokenize(word.lower() if self.mode == "drop" else "Ġ" + word)
        return array("I", [token.id for token in found]).tobytes()

    def learn_words(self, words: list[str]) -> None:
        """Words of letters only, encoded as one text; the vocabulary says where each of them ends or begins."""
        raw = self.encode([" " + " ".join(words)])[0]
        edge = np.flatnonzero(self.edges[np.frombuffer(raw, "<u4")])
        if len(edge) != len(words):  # a word whose normal form holds a mark; encode one by one
            self.cache.update(zip(words, self.encode([self.text_of(w) for w in words])))
            return
        cuts = [0, *(4 * edge + 4).tolist()] if self.mode == "drop" else [*(4 * edge).tolist(), len(raw)]
        self.cache.update(zip(words, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))

    def uncut(self, column: pa.Array) -> np.ndarray:
        """Flags of the texts that are encoded as one piece."""
        if self.mode is None:
            return np.ones(len(column), bool)
        odd = ODD if self.mode == "drop" else f"{ODD}|{RUNS}"
        return pc.match_substring_regex(column, odd).to_numpy(zero_copy_only=False)

    def chunks(self, column: pa.Array) -> pa.Array:
        """The keys of the chunks of each text."""
        if self.mode == "drop":
            return pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        return pc.split_pattern(pc.utf8_replace_slice(pc.replace_substring(column, "\n", " \n"), 0, 0, "\t"), " ")

    def inner(self, text: str) -> str:
        """The key of a text that follows a letter without a space."""
        return text if self.mode == "drop" else "\t" + text

    def text_of(self, key: str) -> str:
        """keep: a key beginning with a newline is itself, one with a tab starts a text, any other follows a space."""
        if self.mode == "drop" or key[:1] == "\n":
            return key
        return key[1:] if key[:1] == "\t" else " " + key


def chunking(spec: dict) -> str | None:
    """drop: white space only separates; keep: one space belongs to the word after it; None: not known to be cuttable."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and norm is None:
        return "keep"
    parts = pre.get("pretokenizers", [])
    if len(parts) == 2 and parts[0].get("type") == "Split" and parts[0].get("invert") and parts[0].get("behavior") == "Removed" \
            and parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex", True) \
            and "\\s" not in (cut := parts[0]["pattern"].get("Regex", "\\s")).replace("[^\\s", "") and cut.endswith(LETTERS_ALONE) \
            and [n.get("type") for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        return "drop"
    return None


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file, so its cache lasts over tasks."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file of the given name."""
    import public_tokenizers
    return str(public_tokenizers.path(name))
