"""Statistics of whole texts, for batches of documents at once (problem 9).

Characters are looked up in class tables, lines and words are found as changes of class,
and sums per line and document come from running totals, so no character, line or word
is visited in Python except for the look-up of words in a set.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence, Set
from functools import lru_cache
from operator import eq

import numpy as np

SYMBOLS = "|{}<>=*#[]()/\\_&%$^~@+§;"
SENTENCE_ENDS = ".!?…。！？।؟"
#: What may close a line after the end of a sentence.
CLOSERS = "'\"”’»)]>"
BULLETS = "*#;:•-–"
_ENDED = re.compile(rf"(?:[{SENTENCE_ENDS}]['\"”’»)\]]*|</ref>)\Z")
_NUMBERED = re.compile(r"\d{1,4}\s*[.)–-]\s")

#: Statistics, in the order of the mixture's dimensions (the first three enter it as logarithms).
STATS = (
    "n_words", "mean_line", "mean_word", "symbol_ratio", "digit_ratio", "letter_ratio", "punct_lines", "ended_share", "common_share", "flow_share",
    "list_lines", "name_share", "switch_ratio", "repeat_ratio", "distinct_ratio",
)
#: Share of common words from which a line counts as running text.
FLOW = 0.2
#: Characters that are worked on at once; a longer text is worked on alone.
AT_ONCE = 1 << 20

SPACE, OTHER, DIGIT, LOWER, UPPER, HIRAGANA, KATAKANA, HAN = range(8)


def _class_of(c: str) -> int:
    if c.isspace():
        return SPACE
    if "ぁ" <= c <= "ゟ":
        return HIRAGANA
    if "゠" <= c <= "ヿ":
        return KATAKANA
    if "㐀" <= c <= "鿿":
        return HAN
    if c.isalpha():
        return UPPER if c.isupper() else LOWER
    if c.isdigit():
        return DIGIT
    return LOWER if unicodedata.category(c)[0] == "M" else OTHER


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, lower case, 1 for symbols) of the code points of the basic plane; those beyond count as its last one."""
    chars = [chr(i) for i in range(1 << 16)]
    kind = np.array([OTHER if 0xD800 <= i < 0xE000 else _class_of(c) for i, c in enumerate(chars)], dtype=np.uint8)
    low = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars)], dtype=np.uint32)
    symbol = np.zeros(1 << 16, dtype=bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    return kind, low, symbol


class Marked:
    """Texts joined, each closed by a line feed, with lines and words marked."""

    def __init__(self, texts: Sequence[str]):
        kind, low, symbol = _tables()
        self.texts = texts
        # a line feed in front lets every word look at the character before it
        big = "\n" + "\n".join(texts) + "\n"
        self.code = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        at = np.minimum(self.code, 0xFFFF).astype(np.uint16)
        self.kind, self.symbol = kind[at], symbol[at]
        letter = self.kind >= LOWER
        script = np.where(letter, np.maximum(self.kind, UPPER), 0)
        change = script[1:] != script[:-1]
        self.starts = np.flatnonzero(change & letter[1:]) + 1
        self.ends = np.flatnonzero(change & letter[:-1])
        out = np.where(letter, low[at], 32).astype("<u4")
        # words of two scripts that touch are parted
        joined = self.starts[letter[self.starts - 1]]
        if len(joined):
            out = np.insert(out, joined, 32)
        self.words = out.tobytes().decode("utf-32-le", "surrogatepass").split(" ")
        self.words = [w for w in self.words if w]
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.sizes = sizes - 1
        self.doc_ends = np.cumsum(sizes)  # position of each text's closing line feed
        self.word_ends = np.searchsorted(self.starts, self.doc_ends)

    def free(self) -> np.ndarray:
        """True for words that touch no symbol of markup or code."""
        return ~(self.symbol[self.starts - 1] | self.symbol[self.ends + 1])

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        upto = total[self.doc_ends]
        return upto - np.concatenate([[0], upto[:-1]])


def _groups(texts: Sequence[str | None]):
    """(first, texts) of parts of about ``AT_ONCE`` characters."""
    part: list[str] = []
    size = first = 0
    for i, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > AT_ONCE:
            yield first, part
            part, size, first = [], 0, i
        part.append(t)
        size += len(t) + 1
    if part:
        yield first, part


def free_words(texts: Sequence[str | None]):
    """For each text its different words in lower case that touch no symbol."""
    for _, part in _groups(texts):
        m = Marked(part)
        free, a = m.free().tolist(), 0
        for b in m.word_ends.tolist():
            yield {w for w, f in zip(m.words[a:b], free[a:b]) if f}
            a = b


def statistics(texts: Sequence[str | None], common: Set[str]) -> np.ndarray:
    """A row of the values of ``STATS`` for each text; all 0 where it is null, empty or blank.

    Words are runs of letters of one script; ``common`` are the common words, in lower
    case. n_words: words. mean_line: visible characters per line that is not blank.
    mean_word: letters per word. symbol_ratio, digit_ratio, letter_ratio: symbols of
    markup and code, digits, letters, per character. punct_lines: share of lines that end
    like a sentence; ended_share: share of the characters in such lines. common_share:
    common words that touch no symbol, per word. flow_share: share of the characters in
    lines of at least three words of which a fifth are such common words. list_lines:
    share of lines that begin like list items. name_share: words with a capital, per
    word. switch_ratio: changes from lower to upper case and between letters and digits,
    per character. repeat_ratio: words like the one before, per word, and characters like
    the one before, per character. distinct_ratio: different words per word.
    """
    out = np.zeros((len(texts), len(STATS)))
    for first, part in _groups(texts):
        out[first : first + len(part)] = _statistics(part, common)
    return out


def _statistics(texts: list[str], common: Set[str]) -> np.ndarray:
    m = Marked(texts)
    kind, starts = m.kind, m.starts
    size = np.maximum(m.sizes, 1)
    visible = kind != SPACE
    letters = m.per_doc(kind >= LOWER)
    # lines: the line feed in front ends an empty one
    feeds = np.flatnonzero(m.code == 10)
    line_start, line_end = feeds[:-1] + 1, feeds[1:]
    length = feeds[1:] - feeds[:-1]
    shown = np.concatenate([[0], np.cumsum(visible, dtype=np.int64)])
    full = shown[line_end] > shown[line_start]
    line_start, line_end, length = line_start[full], line_end[full], length[full]
    visible_at = np.flatnonzero(visible)
    head = visible_at[shown[line_start]] if len(line_start) else line_start
    tail = visible_at[shown[line_end] - 1] if len(line_end) else line_end
    n_lines = len(head)
    last = m.code[tail]
    ended = np.isin(last, [ord(c) for c in SENTENCE_ENDS])
    text_of = np.searchsorted(m.doc_ends, head)
    text_start = np.concatenate([[1], m.doc_ends[:-1] + 1])
    for i in np.flatnonzero(np.isin(last, [ord(c) for c in CLOSERS])).tolist():
        d = text_of[i]
        a, b = int(head[i] - text_start[d]), int(tail[i] + 1 - text_start[d])
        ended[i] = _ENDED.search(texts[d][max(a, b - 40) : b]) is not None
    c0 = m.code[head]
    listed = np.isin(c0, [ord(c) for c in BULLETS])
    for i in np.flatnonzero(kind[head] == DIGIT).tolist():
        a = int(head[i] - text_start[text_of[i]])
        listed[i] = _NUMBERED.match(texts[text_of[i]][a : a + 12]) is not None
    # words
    is_common = np.fromiter(map(common.__contains__, m.words), dtype=bool, count=len(m.words)) & m.free()
    line_of = np.searchsorted(line_end, starts)
    words_in = np.bincount(line_of, minlength=n_lines)[:n_lines]
    common_in = np.bincount(line_of[is_common], minlength=n_lines)[:n_lines]
    flows = (words_in >= 3) & (common_in >= FLOW * words_in)
    docs = len(texts)
    by_doc = lambda x: np.bincount(text_of, weights=x, minlength=docs)
    lines = np.maximum(by_doc(np.ones(n_lines)), 1)
    n_words = np.diff(m.word_ends, prepend=0)
    word_doc = np.repeat(np.arange(docs), n_words)
    words = np.maximum(n_words, 1)
    again = np.zeros(len(m.words), dtype=bool)
    again[1:] = np.fromiter(map(eq, m.words[1:], m.words), dtype=bool, count=max(0, len(m.words) - 1))
    again[m.word_ends[:-1][m.word_ends[:-1] < len(again)]] = False
    a, distinct = 0, np.zeros(docs)
    for d, b in enumerate(m.word_ends.tolist()):
        distinct[d] = len(set(m.words[a:b]))
        a = b
    same = np.zeros(len(kind), dtype=bool)
    same[1:] = (m.code[1:] == m.code[:-1]) & visible[1:]
    switch = np.zeros(len(kind), dtype=bool)
    k0, k1 = kind[:-1], kind[1:]
    switch[1:] = ((k0 == LOWER) & (k1 == UPPER)) | ((k0 == DIGIT) & ((k1 == LOWER) | (k1 == UPPER))) | ((k1 == DIGIT) & ((k0 == LOWER) | (k0 == UPPER)))
    per_word = lambda flags: np.bincount(word_doc[flags], minlength=docs) / words
    got = np.column_stack([
        n_words, m.per_doc(visible) / lines, letters / words, m.per_doc(m.symbol) / size, m.per_doc(kind == DIGIT) / size, letters / size,
        by_doc(ended) / lines, np.minimum(1, by_doc(ended * length) / size), per_word(is_common), np.minimum(1, by_doc(flows * length) / size),
        by_doc(listed) / lines, per_word(kind[starts] == UPPER), m.per_doc(switch) / size, per_word(again) + m.per_doc(same) / size, distinct / words,
    ])
    got[m.per_doc(visible) == 0] = 0
    return got
