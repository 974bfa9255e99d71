"""BPE encoding by speculation and verification, and decoding.

Of each word, tokens are proposed by greedy longest match. A token sequence is what merging by rank
gives exactly if each token is what its own text merges to and no merge joins two neighbours before
both are complete, so the proposals of all new words of a batch are checked by their adjacent pairs,
all at once as arrays. Only words with a pair that fails are merged one by one.

A tokenizers file says how texts become words: normalizer, pre-tokenizer and added tokens are the
library's, with a shorter way for plain characters. Each document is encoded where it is read, and a
worker keeps the ids of the words it has met, up to a bound.

Defined cases: null and empty texts, and those of white space that the file drops, have no ids and
decode to an empty text; null ids decode to null; strings of added tokens inside a text are those
tokens, as by the library's default; repeated rows are encoded one by one; other columns are kept, and
a column with the name of the result column is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenogrid.llm.common import resident, small_batches, table
from phenogrid.llm.pretokens import default_path

#: Words that a worker's cache holds at most, and letters of the longest that it keeps.
CACHE_WORDS, CACHE_LETTERS = 500_000, 64
#: Letters of texts that are split into words before they are encoded together.
BLOCK_LETTERS = 4_000_000

#: Letters up to which a word is merged by looking through its pairs, and not by a heap.
SHORT_WORD = 40

NEVER = int(np.iinfo(np.int64).max)

# The pre-tokenizer for which there is a shorter way, and the characters on which it and this module agree.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-ɏ‐-‧‰-‾€]*")
_LAST_PLAIN = 0x24F


def byte_letters() -> list[str]:
    """The letter by which byte-level files write each byte."""
    shown = [c for c in range(256) if chr(c).isprintable() and c not in (0x20, 0xA0, 0xAD)]
    names = {c: chr(c) for c in shown}
    for c in range(256):
        if c not in names:
            names[c] = chr(256 + len(names) - len(shown))
    return [names[c] for c in range(256)]


class Merges:
    """A list of merges as arrays: of each token its parts and the time at which it is made, which is its merge's place."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        size = max(vocab.values()) + 1
        self.size, self.left, self.right = size, np.full(size, -1), np.full(size, -1)
        self.birth, self.known, self.sound = np.full(size, -1, np.int64), np.zeros(size, bool), True
        keys = np.empty(len(merges), np.int64)
        self.wholes = []
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            # A token that two merges make, or that is part of an earlier merge, has no one time.
            self.sound &= self.birth[whole] < 0 and self.birth[left] < rank and self.birth[right] < rank
            self.left[whole], self.right[whole], self.birth[whole] = left, right, rank
            keys[rank] = left * size + right
            self.wholes.append(whole)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.pairs = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        self.alone = np.zeros(size, bool)  # tokens that are what their own text merges to
        for token, i in vocab.items():
            self.alone[i] = self.birth[i] < 0 and len(token.removesuffix(suffix) if suffix else token) == 1
        whole = np.array(sorted(np.flatnonzero(self.birth >= 0), key=lambda i: self.birth[i]), np.int64)
        fits = self.compatible(self.left[whole], self.right[whole], self.birth[whole])
        for i, ok in zip(whole, fits, strict=True):
            self.alone[i] = ok and self.alone[self.left[i]] and self.alone[self.right[i]]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the merge of each pair, NEVER where there is none."""
        keys = a * self.size + b
        if not len(self.keys):
            return np.full(len(keys), NEVER)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a and b, side by side, stay apart until a time (or for ever).

        At each time one part of a lies at the border, and one of b. Going back in time, the part made
        last gives way to what it was made of. The border is crossed if parts that are there together
        have a merge that comes before the one that ends either; of equal merges the left one comes
        first, so the part of a must be outlived.
        """
        ok = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.copy(), b.copy()
        end_x = np.full(len(a), NEVER) if until is None else until.copy()
        end_y = end_x.copy()
        while len(at):
            rank = self.rank(x, y)
            crossed = (rank < end_x) & (rank <= end_y)
            ok[at[crossed]] = False
            go = ~crossed & ((self.birth[x] >= 0) | (self.birth[y] >= 0))
            at, x, y, end_x, end_y = at[go], x[go], y[go], end_x[go], end_y[go]
            back = self.birth[x] >= self.birth[y]
            end_x, end_y = np.where(back, self.birth[x], end_x), np.where(back, end_y, self.birth[y])
            x, y = np.where(back, self.right[x], x), np.where(back, y, self.left[y])
        return ok

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging by rank, of equal ones the leftmost first."""
        return self._merge_short(list(ids)) if len(ids) <= SHORT_WORD else self._merge_long(list(ids))

    def _merge_short(self, ids: list[int]) -> list[int]:
        size, rank = self.size, self.pairs.get
        ranks = [rank(a * size + b, NEVER) for a, b in pairwise(ids)]
        while ranks and (least := min(ranks)) < NEVER:
            i = ranks.index(least)
            new = ids[i] = self.wholes[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] * size + new, NEVER)
            if i < len(ranks):
                ranks[i] = rank(new * size + ids[i + 1], NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get(ids[i] * self.size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.wholes[rank], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right >= 0 and (r := self.pairs.get(ids[left] * self.size + ids[right])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]


class WordCoder:
    """Encodes and decodes with the tokenizers file at `path`, whose model must be byte-level BPE."""

    def __init__(self, path: str, entries: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        model, added = kind["model"], kind.get("added_tokens") or []
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [a["content"] for a in added if a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"]]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"{path} has what isn't supported here: {model['type']} {odd}")
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.merges = Merges(vocab, model["merges"], self.suffix)
        self.letters = byte_letters()
        self.named, self.byte_of = dict(enumerate(self.letters)), {c: i for i, c in enumerate(self.letters)}
        alone = self.merges.alone
        # Tokens that may be proposed: within a word, and at its end, where the suffix belongs to its last letter.
        self.inner = {t: i for t, i in vocab.items() if alone[i] and not (self.suffix and t.endswith(self.suffix))}
        self.last = {t.removesuffix(self.suffix): i for t, i in vocab.items() if alone[i] and t.endswith(self.suffix)}
        self.single = {c: (vocab[c], vocab[c + self.suffix]) for c in self.letters if c in vocab and c + self.suffix in vocab}
        if len(self.single) < 256:
            raise ValueError(f"{path} has no token for some bytes")
        # The longest token of each three first letters.
        self.reach: dict[str, int] = {}
        for token in [*self.inner, *self.last]:
            if len(token) > 2:
                self.reach[token[:3]] = max(len(token), self.reach.get(token[:3], 0))
        self.added = {a["content"]: a["id"] for a in added}
        names = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.find = self._short_way(kind)
        self.entries, self.cache = entries, {}
        self.proposed = self.failed = 0

    def _short_way(self, kind: dict):
        """The pre-tokenizer as a pattern for plain characters in lower case, if the file's is the known one."""
        steps = (kind.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = [n["type"] for n in (kind.get("normalizer") or {}).get("normalizers", [])]
        split, last = steps[0], steps[-1]
        if normal != WORD_NORMALIZERS or (split.get("pattern") or {}).get("Regex") != WORD_PATTERN or not split.get("invert") or last.get("type") != "ByteLevel" or last.get("use_regex"):
            return None
        plain = sorted({d for c in map(chr, range(_LAST_PLAIN + 1)) for d in c.lower()})
        group = lambda k: "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == k)
        letter, number = group("L"), group("N")
        return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\\s{letter}{number}]+").findall

    def words(self, text: str) -> list:
        """The text's words, and added tokens as numbers, in order."""
        if self.special is None or not any(name in text for name in self.added):
            return self._words(text)
        out: list = []
        for i, part in enumerate(self.special.split(text)):
            out += [self.added[part]] if i % 2 else self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if self.find and PLAIN.fullmatch(text):
            return self.find(text.lower())
        normal = self.tokenizer.normalizer
        spelled = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal.normalize_str(text) if normal else text)
        return [w for w, _ in spelled if w] if self.find is None else [self._unspelled(w) for w, _ in spelled if w]

    def _unspelled(self, word: str) -> str:
        """A word of byte letters as its text, so that both ways share one cache."""
        return word if word.isascii() else bytes(map(self.byte_of.__getitem__, word)).decode()

    def _spelled(self, word: str) -> str:
        if self.find is None or (word.isascii() and word.isprintable() and " " not in word):
            return word
        return word.encode().decode("latin-1").translate(self.named)

    def propose(self, word: str) -> list[int]:
        """Greedy longest match over a word of byte letters."""
        whole = self.last.get(word)
        if whole is not None:
            return [whole]
        out, at, n = [], 0, len(word)
        inner, last, reach = self.inner, self.last, self.reach
        while at < n:
            end = min(n, at + reach.get(word[at : at + 3], 2))
            if end == n:
                found = last.get(word[at:])
                if found is not None:
                    out.append(found)
                    break
                # A word's last letter is a token of another kind.
                end = n - 1
            while (found := inner.get(word[at:end])) is None:
                end -= 1
            out.append(found)
            at = end
        return out

    def merged(self, word: str) -> list[int]:
        return self.merges.merge([self.single[c][0] for c in word[:-1]] + [self.single[word[-1]][1]])

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of distinct words as bytes: proposals, one check of all their adjacent pairs, exact merging of what fails."""
        words = list(words)
        spelled = list(map(self._spelled, words))
        ids = list(map(self.propose, spelled))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(ids)), sizes)
        at = np.flatnonzero(of[1:] == of[:-1])
        pairs, back = np.unique(flat[at] * self.merges.size + flat[at + 1], return_inverse=True)
        fits = self.merges.compatible(pairs // self.merges.size, pairs % self.merges.size) if self.merges.sound else np.zeros(len(pairs), bool)
        failed = np.unique(of[at[~fits[back]]])
        self.proposed, self.failed = self.proposed + len(words), self.failed + len(failed)
        for i in failed:
            ids[i] = self.merged(spelled[i])
        return {w: array("i", x).tobytes() for w, x in zip(words, ids, strict=True)}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes of 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            block, letters = [], 0
            while at < len(texts) and (not block or letters < BLOCK_LETTERS):
                letters += len(texts[at] or "")
                block.append(self.words(texts[at]) if texts[at] else [])
                at += 1
            distinct = set().union(*block)
            known = {w: b for w in distinct if (b := self.cache.get(w)) is not None}
            known |= {i: array("i", [i]).tobytes() for i in distinct if isinstance(i, int)}
            new = self.encode_words(distinct - known.keys())
            known |= new
            out += [b"".join(map(known.__getitem__, words)) for words in block]
            if len(self.cache) + len(new) > self.entries:
                self.cache.clear()
            self.cache.update((w, b) for w, b in list(new.items())[: self.entries] if len(w) <= CACHE_LETTERS)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The library's text of ids, added tokens included; numbers that the file hasn't are left out."""
        tokens = list(map(self.names.get, ids))
        if None in tokens:
            tokens = [t for t in tokens if t is not None]
        return self.tokenizer.decoder.decode(tokens) if self.tokenizer.decoder else " ".join(tokens)


def word_coder(path: str) -> WordCoder:
    """This worker's coder."""
    return resident(("words", path), lambda: WordCoder(path))


def encode_bpe(docs: DataFrame, text_col: str = "text", path: str | None = None, result_col: str = "ids") -> DataFrame:
    """docs with the ids of each text, an array of integers."""
    path = path or default_path("word_bpe_49k.json")

    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = word_coder(path)
        for part in parts:
            rows = coder.encode(part.to_pylist())
            ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    encode.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Else a column made of ids would encode the text again for itself.
    udf = F.arrow_udf(encode, T.ArrayType(T.IntegerType())).asNondeterministic()
    return docs.withColumn(result_col, udf(F.col(text_col).cast("string")))


def decode_bpe(ids: Column | str, path: str | None = None) -> Column:
    """The text of a column of ids, special tokens included."""
    path = path or default_path("word_bpe_49k.json")

    def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = word_coder(path)
        for part in parts:
            ids, missing = part.flatten().to_numpy(zero_copy_only=False).tolist(), part.is_null().to_pylist()
            ends = np.concatenate([[0], np.cumsum(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
            yield pa.array([None if no else coder.decode(ids[a:b]) for no, (a, b) in zip(missing, pairwise(ends), strict=True)], pa.string())

    decode.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decode, T.StringType())(ids)


def op11_bpe(spark, sf_dir):
    small_batches(spark)
    coded = encode_bpe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    coded = coded.select("doc_id", "ids", decode_bpe("ids").alias("decoded"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
