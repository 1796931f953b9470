"""Quality rules from tokeniser fertility.

A public vocabulary, made for ordinary writing, spends few tokens on ordinary text. Two are measured: one
of pieces with byte fallback and one of bytes for many languages. Characters per token of both, the share
of tokens that fall back to bytes and the entropy of a document's tokens tell junk (encodings, symbol
noise, shouting, words of no language, loops) from prose: what one vocabulary spells as easily as prose,
the other often doesn't. Bands differ by language, since a vocabulary splits some languages much finer than
others; a document of another language is held against the bands of its script. Documents of few tokens
vary more: below `min_tokens` bands widen with 1 / sqrt(tokens), so every document is judged.

Each word is encoded alone, with the space before it: the vocabularies never join pieces across white
space, so that gives the tokens of the whole text without its white space. One task encodes each
distinct word of a block once. Documents go to no other task: there is no shuffle.

Null or empty text: no words, no tokens, base_failed (fewer than 20 words), kept false. Extra columns are
carried only by `filter_documents`; `fertility` returns its own columns, so names can't clash.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm import textbatch as tb

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How that vocabulary cuts text before it joins bytes; a fixed value of the vocabulary.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, "
    "token_entropy double, n_byte_tokens long, chars_per_byte_token double, script string, base_failed boolean, reason string, kept boolean"
)
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Band:
    """Rejection limits. The entropy limit is a share of what a document of so many tokens could have at most."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: float
    min_chars_per_byte_token: float


@dataclass(frozen=True)
class Rules:
    vocabulary: str = VOCABULARY
    byte_vocabulary: str = BYTE_VOCABULARY
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    min_tokens: int = 100  # below, a document's bands are wider
    wider: float = 0.15  # by what share at a quarter of these tokens; it grows with 1 / sqrt(n)
    bands: dict = field(
        default_factory=lambda: {
            "en": Band(1.85, 8.0, 0.10, 0.50, 1.88),
            "de": Band(1.80, 8.0, 0.10, 0.50, 1.95),
            "fr": Band(1.65, 8.0, 0.10, 0.50, 1.75),
            "es": Band(1.55, 8.0, 0.10, 0.50, 1.80),
            "latin": Band(1.40, 9.0, 0.15, 0.35, 1.30),
            "greek": Band(0.70, 8.0, 0.50, 0.35, 0.40),
            "cyrillic": Band(1.30, 8.0, 0.25, 0.35, 0.40),
            "semitic": Band(0.50, 8.0, 0.90, 0.35, 0.40),
            "kana and han": Band(0.30, 8.0, 1.00, 0.30, 0.25),
            "hangul": Band(0.30, 8.0, 1.00, 0.30, 0.25),
            "other": Band(0.20, 8.0, 1.00, 0.30, 0.20),
        }
    )


class Encoder:
    """Tokens of distinct words, kept between blocks up to a fixed number of words."""

    MOST = 100_000

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            model = tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.is_byte = np.zeros(max(ranks.values()) + 1, bool)
            self.is_byte[[r for t, r in ranks.items() if len(t) == 1 and t[0] >= 0x80]] = True
            self.encode = lambda words: [model.encode_ordinary(f" {w}") for w in words]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
            self.encode = lambda words: model.encode(words, num_threads=1)
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.ids, self.ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]

    def tokens(self, data: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: ids of all known words, and where each asked word's ids begin and end."""
        if len(self.at) > self.MOST:
            self.clear()
        keys = hashes.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.at]
        if new:
            raw = data.tobytes()
            found = self.encode([raw[s:e].decode() for s, e in zip(start[new].tolist(), end[new].tolist())])
            known = len(self.at)
            self.at.update(zip((keys[i] for i in new), range(known, known + len(new))))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.ids.append(np.fromiter((x for ids in found for x in ids), np.int32, int(sizes.sum())))
            self.ends.append(self.ends[-1][-1] + np.cumsum(sizes))
        self.ids, self.ends = [np.concatenate(self.ids)], [np.concatenate(self.ends)]
        at = np.fromiter((self.at[k] for k in keys), np.int64, len(keys))
        return self.ids[0], self.ends[0][at], self.ends[0][at + 1]


def ragged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indices of the ranges [lo, hi), one range after the other, and the number of the range of each."""
    sizes = hi - lo
    which = np.repeat(np.arange(len(lo)), sizes)
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - first[which] + lo[which], which


#: Scripts, and the first bytes of their letters in UTF-8.
SCRIPTS = {"greek": (0xCE, 0xCF), "cyrillic": (0xD0, 0xD3), "semitic": (0xD6, 0xDD), "other": (0xE0, 0xE2), "kana and han": (0xE3, 0xE9), "hangul": (0xEA, 0xED)}


def scripts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The script that most of a text's letters are in; latin where there are as many of it."""
    latin = tb.per_row(offsets, ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 0xC3) & (data <= 0xC9))
    counts = [latin, *(tb.per_row(offsets, (data >= lo) & (data <= hi)) for lo, hi in SCRIPTS.values())]
    return np.array(["latin", *SCRIPTS])[np.argmax(counts, axis=0)]


def measure(data: np.ndarray, offsets: np.ndarray, encoder: Encoder, rules: Rules) -> dict[str, np.ndarray]:
    """The figures of each row of a block, by column."""
    words = tb.Words(data, offsets)
    rows, n = words.rows, words.count
    heads = (data & 0xC0) != 0x80
    out = {"n_words": n, "word_chars": tb.per_row(offsets, heads & words.black), "n_symbols": tb.per_row(offsets, SYMBOL[data])}

    # lines with a word that an earlier line of the same text equals
    breaks = np.flatnonzero(data == 10)
    edge = np.unique(np.concatenate([offsets, breaks + 1]))
    start, end = edge[:-1], edge[1:]
    end = end - (data[end - 1] == 10) if len(start) else end
    total = np.concatenate([[0], np.cumsum(words.black)])
    full = total[end] > total[start] if len(start) else np.zeros(0, bool)
    start, end = start[full], end[full]
    row = np.searchsorted(offsets, start, "right") - 1
    distinct = np.unique(tb.mix(words.hashes(start, end) ^ (row.astype(np.uint64) * tb.BASE)), return_index=True)[1]
    out["n_dup_lines"] = np.bincount(row, minlength=rows) - np.bincount(row[distinct], minlength=rows)

    # words inside windows that the text has twice or more
    first, gram = words.grams(rules.window)
    gram = tb.mix(gram ^ (words.row[first].astype(np.uint64) * tb.BASE))
    _, back, times = np.unique(gram, return_inverse=True, return_counts=True)
    cover = np.zeros(len(words.hash) + 1, np.int64)
    twice = first[times[back] > 1]
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + rules.window, -1)
    out["n_repeat_words"] = np.bincount(words.row, np.cumsum(cover[:-1]) > 0, minlength=rows).astype(np.int64)

    # tokens
    keys, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
    ids, lo, hi = encoder.tokens(data, keys, words.start[at], words.end[at])
    byte_tokens = np.concatenate([[0], np.cumsum(encoder.is_byte[ids])])
    bytes_of = byte_tokens[hi] - byte_tokens[lo]
    n_tokens = np.bincount(words.row, (hi - lo)[back], minlength=rows)
    n_bytes = np.bincount(words.row, bytes_of[back], minlength=rows)
    where, which = ragged(lo[back], hi[back])
    pairs, times = np.unique((words.row[which].astype(np.uint64) << np.uint64(32)) | ids[where].astype(np.uint64), return_counts=True)
    weight = np.bincount((pairs >> np.uint64(32)).astype(np.int64), times * np.log2(np.maximum(times, 1)), minlength=rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        out["n_tokens"] = n_tokens.astype(np.int64)
        out["chars_per_token"] = np.where(n_tokens > 0, out["word_chars"] / n_tokens, 0.0)
        out["byte_share"] = np.where(n_tokens > 0, n_bytes / n_tokens, 0.0)
        out["token_entropy"] = np.round(np.where(n_tokens > 0, np.maximum(np.log2(np.maximum(n_tokens, 1)) - weight / np.maximum(n_tokens, 1), 0), 0.0), 9)

    _, lo, hi = encoder_for(rules.byte_vocabulary).tokens(data, keys, words.start[at], words.end[at])
    out["n_byte_tokens"] = np.bincount(words.row, (hi - lo)[back], minlength=rows).astype(np.int64)
    out["chars_per_byte_token"] = out["word_chars"] / np.maximum(out["n_byte_tokens"], 1)
    out["script"] = scripts(data, offsets)
    return out


def judge(m: dict[str, np.ndarray], langs: list, rules: Rules) -> None:
    """Adds base_failed, reason and kept."""
    base = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])
    bands = [rules.bands.get(lang) or rules.bands.get(script) or rules.bands["other"] for lang, script in zip(langs, m["script"])]
    low, high, most, least, low_bytes = (np.array([getattr(b, f.name) for b in bands], float) for f in Band.__dataclass_fields__.values())
    # the fewer tokens, the more figures vary: no wider from min_tokens on
    some, n = m["n_tokens"] > 0, np.maximum(m["n_tokens"], 1)
    wider = 1 + rules.wider * np.maximum(np.sqrt(rules.min_tokens / n) - 1, 0)
    low, low_bytes, least, high, most = low / wider, low_bytes / wider, least / wider, high * wider, most * wider
    # n tokens have log2(n) bits at most, and prose of any length little more than a dozen
    room = np.minimum(np.log2(np.maximum(m["n_tokens"], 2)), 12.0)
    why = np.full(len(base), None, object)
    for name, bad in (
        ("token entropy", some & (m["token_entropy"] < least * room)),
        ("byte fallback", some & (m["byte_share"] > most)),
        ("characters per token, high", some & (m["chars_per_token"] > high)),
        ("characters per byte token, low", some & (m["chars_per_byte_token"] < low_bytes)),
        ("characters per token, low", some & (m["chars_per_token"] < low)),
        ("repeated words", 100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"]),
        ("few words", m["n_words"] < rules.min_words),
    ):
        why[bad] = name
    m["base_failed"], m["reason"], m["kept"] = base, why, np.array([w is None for w in why], bool)


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Drops the words that encoders keep: a Python worker outlives its task, and serves other stages beside it."""
    for encoder in _encoders.values():
        encoder.clear()
    tb.release()


def fertility(documents: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: its key, the figures of `measure` and the verdict.

    Repeated rows give repeated results; a null key stays null. Without a `lang` column all documents
    are judged by script.
    """
    kind = documents.schema[key].dataType.simpleString()
    lang_of = F.col(lang) if lang in documents.columns else F.lit(None)
    source = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), lang_of.cast("string").alias("lang"))
    fields = [x.strip().rsplit(" ", 1) for x in COLUMNS.split(",")]
    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(block: pa.RecordBatch):
        m = measure(*tb.utf8(block.column(1)), encoder_for(rules.vocabulary), rules)
        judge(m, block.column(2).to_pylist(), rules)
        yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(m[n], types[t]) for n, t in fields)], names=["key", *(n for n, _ in fields)])

    return tb.map_blocks(source, run, f"key {kind}, {COLUMNS}").withColumnRenamed("key", key)


def filter_documents(documents: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that pass, with all their columns and nothing else. No shuffle, no join."""
    schema = documents.schema
    names = documents.columns
    at_text, at_lang = names.index(text), names.index(lang) if lang in names else None

    def run(block: pa.RecordBatch):
        m = measure(*tb.utf8(block.column(at_text)), encoder_for(rules.vocabulary), rules)
        judge(m, block.column(at_lang).to_pylist() if at_lang is not None else [None] * block.num_rows, rules)
        yield block.filter(pa.array(m["kept"]))

    def over(batches):
        for block in tb.blocks(batches, names[at_text], 1 << 20):
            yield from run(block)
            tb.release()
        forget()

    return documents.mapInArrow(over, schema)
