"""Prose of texts as streams of letters, found with array operations over whole chunks of texts.

A text's blocks lie between blank lines (comment stars in front of a line do not count). Left out of the prose are fenced and
plain code, inline code, names of things in code (dotted, dashed, in camel case, with digits), addresses, short quotations and
format characters; what is left comes in lower case, one blank between words.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np

#: Blanks before and after each paragraph's stream, so that no n-gram up to this length spans two paragraphs.
PAD = 5
#: Letters of prose that make a paragraph; code signs a letter from which a block is code.
LEAST_LETTERS, CODE_SHARE = 4, 0.10
_OTHER, _SPACE, _NEWLINE, _LETTER, _UPPER, _CJK, _DIGIT, _UNDER, _LINK, _GONE, _MARK = range(11)
_SIZE = 0x30000
_QUOTE = re.compile(r"“[^“”]{0,60}”|«[^«»]{0,60}»|„[^„“”]{0,60}[“”]|「[^「」]{0,60}」|『[^『』]{0,60}』|\"[^\"\n]{0,60}\"")
_INLINE = re.compile(r"(?<!`)`[^`\n]+`(?!`)")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>|&(?:[a-zA-Z]{2,8}|#\d{1,6});|\{@\w+[^}\n]*\}")
_JOINED = re.compile(r"(?:[^\W_]+[^\w\s]*_){4,}")
#: Signs of code (a) that prose has too, (b) that it hardly has; a line of code ends with the first three or begins with braces.
_SOFT, _HARD = "()[]", ";{}=<>&|"
_tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def _table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, lower case and code sign (1: soft, 2: hard) of each code point; built once a process."""
    global _tables
    if _tables is None:
        kind = np.full(_SIZE, _OTHER, dtype=np.uint8)
        low = np.arange(_SIZE, dtype=np.uint32)
        for cp in range(_SIZE):
            c = chr(cp)
            cat = unicodedata.category(c)
            if cat in ("Lo", "Lm") and 0x2E80 <= cp:
                kind[cp] = _CJK
            elif cat == "Lu" or cat == "Lt":
                kind[cp] = _UPPER
                if len(c.lower()) == 1:
                    low[cp] = ord(c.lower())
            elif cat[0] == "L":
                kind[cp] = _LETTER
            elif cat[0] == "N":
                kind[cp] = _DIGIT
            elif cat == "Cf":
                kind[cp] = _GONE
            elif cat[0] == "M":
                kind[cp] = _MARK
            elif c.isspace():
                kind[cp] = _SPACE
        for c in "\n\r\x0b\x0c\x85  ":
            kind[ord(c)] = _NEWLINE
        kind[ord("_")] = _UNDER
        for c in ".:/\\#-@$":
            kind[ord(c)] = _LINK
        for cp in range(0xFF01, 0xFF5F):  # full-width forms of ASCII letters and digits
            plain = cp - 0xFEE0
            if chr(plain).isalnum():
                kind[cp], low[cp] = kind[plain], low[plain]
        sign = np.zeros(_SIZE, dtype=np.uint8)
        sign[[ord(c) for c in _SOFT]] = 1
        sign[[ord(c) for c in _HARD]] = 2
        _tables = kind, low, sign
    return _tables


@dataclass
class Streams:
    """cp[start[i]:end[i]] is the prose of paragraph `number[i]` of text `text[i]`; PAD blanks stand on both sides of it."""

    cp: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    number: np.ndarray
    letters: np.ndarray


def _clean(t: str) -> str:
    if "\r" in t:
        t = t.replace("\r\n", "\n")
    if not t.isascii() and not unicodedata.is_normalized("NFC", t):
        t = unicodedata.normalize("NFC", t)
    if "_" in t:
        t = _JOINED.sub(lambda m: m[0].replace("_", " "), t)
    if "<" in t or "&" in t or "{@" in t:
        t = _TAG.sub(" ", t)
    if "`" in t:
        t = _INLINE.sub(" ", t)
    if '"' in t or "“" in t or "«" in t or "„" in t or "「" in t or "『" in t:
        t = _QUOTE.sub(" ", t)
    return t


def _first_per(group: np.ndarray, at: np.ndarray, n: int, default: int) -> np.ndarray:
    """at of the first member of each group 0..n-1; groups come in order."""
    out = np.full(n, default, dtype=np.int64)
    g, first = np.unique(group, return_index=True)
    out[g] = at[first]
    return out


def streams(texts: list[str]) -> Streams:
    kind_of, low_of, sign_of = _table()
    if not texts:
        z = np.zeros(0, dtype=np.int64)
        return Streams(np.full(2 * PAD, 32, dtype=np.uint32), z, z, z, z, z)
    cleaned = [_clean(t) + "\n\n" for t in texts]
    cp = np.frombuffer("".join(cleaned).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t) for t in cleaned])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    if len(cp) and cp.max() >= _SIZE:
        cp = np.minimum(cp, _SIZE - 1)
    kind = kind_of[cp]
    gone = kind == _GONE
    if gone.any():
        cp, owner, kind = cp[~gone], owner[~gone], kind[~gone]
    # lines; a star or a double slash in front of one counts as blank
    newline = kind == _NEWLINE
    line = np.cumsum(newline, dtype=np.int32) - newline
    n_lines = int(line[-1]) + 1 if len(line) else 0
    line_owner = owner[np.flatnonzero(newline)]
    solid = np.flatnonzero((kind != _SPACE) & ~newline)
    head = _first_per(line[solid], solid, n_lines, -1)
    has = head >= 0
    nxt = np.minimum(head + 1, len(cp) - 1)
    star = has & (cp[head] == 42) & ((kind[nxt] == _SPACE) | newline[nxt] | (cp[nxt] == 47))
    slash = has & (cp[head] == 47) & (cp[nxt] == 47)
    kind = kind.copy()
    kind[head[star]] = _SPACE
    kind[head[slash]] = _SPACE
    kind[nxt[slash]] = _SPACE
    solid = np.flatnonzero((kind != _SPACE) & (kind != _NEWLINE))
    head = _first_per(line[solid], solid, n_lines, -1)
    tail = np.full(n_lines, -1, dtype=np.int64)
    tail[line[solid]] = solid  # the last write holds
    filled = head >= 0
    first_of_text = np.ones(n_lines, dtype=bool)
    first_of_text[1:] = line_owner[1:] != line_owner[:-1]
    opens = filled & (first_of_text | ~np.concatenate([[False], filled[:-1]]))
    block = np.cumsum(opens) - 1
    # fences
    limit = len(cp) - 1
    fence = filled & (cp[head] == 96) & (cp[np.minimum(head + 1, limit)] == 96) & (cp[np.minimum(head + 2, limit)] == 96)
    upto = np.cumsum(fence)
    text_first = np.flatnonzero(first_of_text)
    base = np.zeros(len(texts), dtype=np.int64)
    base[line_owner[text_first]] = upto[text_first] - fence[text_first]
    count = upto - base[line_owner]
    total = np.zeros(len(texts), dtype=np.int64)
    total[line_owner] = count  # the last line's count
    fenced = (count % 2 == 1) | fence
    # a fence that is never closed ends with its block
    last_fence_block = np.full(len(texts), -1, dtype=np.int64)
    f = np.flatnonzero(fence)
    last_fence_block[line_owner[f]] = block[f]
    unclosed = (total[line_owner] % 2 == 1) & (count == total[line_owner])
    fenced &= ~unclosed | (block == last_fence_block[line_owner])
    code_line = fenced | (filled & np.isin(cp[tail], [59, 123, 125])) | (filled & np.isin(cp[head], [123, 125]))
    # blocks with many signs of code for their letters are code
    n_blocks = int(block[-1]) + 1 if n_lines else 0
    letter = (kind == _LETTER) | (kind == _UPPER) | (kind == _CJK)
    blk = block[line]
    free = ~code_line[line]
    in_block = blk >= 0
    free &= in_block
    n_letters = np.bincount(blk[letter & free], minlength=n_blocks)
    at = np.flatnonzero(sign_of[cp])
    at = at[free[at]]
    n_signs = np.bincount(blk[at], minlength=n_blocks)
    n_hard = np.bincount(blk[at[sign_of[cp[at]] == 2]], minlength=n_blocks)
    code_block = (n_hard >= 3) & (n_signs > CODE_SHARE * np.maximum(n_letters, 1))
    # chunks: runs of letters, digits, underscores and signs between them; chunks that look like names are no prose
    word = (kind == _LETTER) | (kind == _UPPER) | (kind == _DIGIT)
    link = (kind == _LINK) | (kind == _UNDER)
    near = np.zeros(len(cp), dtype=bool)
    near[1:-1] = word[:-2] & word[2:]
    link &= near
    part = word | link | (kind == _UNDER)
    begins = part.copy()
    begins[1:] &= ~part[:-1]
    chunk = np.cumsum(begins, dtype=np.int32) - 1
    odd = link | (kind == _DIGIT) | (kind == _UNDER)
    odd[1:] |= (kind[1:] == _UPPER) & (kind[:-1] == _LETTER)
    odd &= part
    n_chunks = int(chunk[-1]) + 1 if len(chunk) else 0
    name = np.zeros(max(n_chunks, 1), dtype=bool)
    name[chunk[odd]] = True
    idx = np.flatnonzero(letter & free)
    idx = idx[~code_block[blk[idx]]]
    idx = idx[~(part[idx] & name[np.maximum(chunk[idx], 0)])]
    if not len(idx):
        z = np.zeros(0, dtype=np.int64)
        return Streams(np.full(2 * PAD, 32, dtype=np.uint32), z, z, z, z, z)
    b = blk[idx]
    fresh = np.ones(len(idx), dtype=bool)
    fresh[1:] = b[1:] != b[:-1]
    gap = np.ones(len(idx), dtype=bool)
    gap[1:] = np.diff(idx) > 1
    pad = np.where(fresh, PAD, np.where(gap, 1, 0))
    at = np.arange(len(idx)) + np.cumsum(pad)
    out = np.full(int(at[-1]) + 1 + PAD, 32, dtype=np.uint32)
    out[at] = low_of[cp[idx]]
    firsts = np.flatnonzero(fresh)
    start = at[firsts]
    end = np.append(at[firsts[1:] - 1] + 1, at[-1] + 1)
    letters = np.diff(np.append(firsts, len(idx)))
    block_line = np.flatnonzero(opens)
    block_owner = line_owner[block_line]
    first_block = np.zeros(len(texts), dtype=np.int64)
    rev = np.arange(n_blocks - 1, -1, -1)
    first_block[block_owner[rev]] = rev  # the last write is the first block
    who = block_owner[b[firsts]]
    number = b[firsts] - first_block[who] + 1
    ok = letters >= LEAST_LETTERS
    return Streams(out, start[ok], end[ok], who[ok], number[ok], letters[ok])
