"""Text read in a wrong character encoding: finding it and putting it right.

Garbled sequences are computed beforehand for all pairs of encodings and matched by multi-pattern automata:

* UTF-8 read as a one-byte encoding: the automaton holds, for each reading encoding, what every first and second byte of
  a UTF-8 sequence are read as, so it covers every character of Unicode with some 60,000 patterns of two characters; the
  few bytes after the second are looked up. Characters of western and central European text, and those the corpus holds
  properly, count wherever they cover enough of the stretch around them. All others count in chains: CHAIN adjacent sequences of one
  encoding that give one script; once a text has such a chain, further sequences of that script and encoding count too.
  Twice read text contains the sequences of the characters it was garbled to and is restored by going through it again.
* Japanese legacy encodings read as a one-byte one: kana and the corpus's own ideographs are in an automaton; from a match
  the bytes are decoded both ways, and chains of CHAIN characters count. UTF-8 read as cp932, GBK or Big5, and EUC-JP read
  as cp932, are found by decoding stretches of ideographs, outside the automaton.
* One legacy encoding read as another: letters turn into other letters, so single characters prove nothing. All words with
  letters outside ASCII that stand in LEAST_DOCUMENTS documents or more, counted over the whole corpus, are garbled for
  every pair; a garbled form counts only where it stands as a word of its own and is far rarer in the corpus than the word
  it came from. In a line with such words, the pair of encodings most of them share is tried on the words the dictionary
  does not know.
* Replacement characters, which stand for what could not be read, cannot be restored but are counted.

Only matched spans are replaced; correct text beside them stays as it is.

The dictionary is never held as a whole. Documents are dealt to blocks by hash; the words of each block are counted, added
up over blocks and garbled in the executors; garbled forms are joined to the words that occur, and each block gets only
the forms and the proper words that its own documents hold. A block's automaton is built where its documents are.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.session import checkpointed, cores

#: Encodings that UTF-8 may have been read in.
READ_UTF8_AS = ["cp1252", "latin_1", "iso8859_15", "cp1250", "iso8859_2", "cp1251", "cp1253", "iso8859_7", "cp1254", "cp1257", "mac_roman", "mac_latin2", "mac_cyrillic", "cp437", "cp850", "cp852", "cp866", "cp737", "koi8_r", "koi8_u", "iso8859_5"]
#: Legacy encodings a text may have been written in and read in.
LEGACY = ["cp1252", "iso8859_15", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp852", "mac_latin2", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1253", "iso8859_7", "cp737"]
JAPANESE = ["cp932", "euc_jp"]
#: Multi-byte encodings that UTF-8 may have been read in.
WIDE = ["cp932", "gbk", "big5"]
#: Documents a dictionary word must be in, and how many times as many as its garbled form.
LEAST_DOCUMENTS, MORE_FREQUENT = 3, 4
#: Garbled characters that make a document a case.
LEAST_GARBLED = 3
LOST = "�"
#: Words stand between ASCII, typographic marks or other words; next to stray signs they are parts of garbled ones.
APART = r"(?<![^\x00-\x7f“”‘’„…–—«»¿¡。、「」\p{L}\p{M}])", r"(?![^\x00-\x7f“”‘’„…–—«»¿¡。、「」\p{L}\p{M}])"
WORD = regex.compile(APART[0] + r"[\p{L}\p{M}’]++" + APART[1])
WORD_CHARACTER = regex.compile(r"[\p{L}\p{M}’]")
#: What stands between ASCII blanks and holds a character outside ASCII.
TOKEN = regex.compile(r"[^\x00-\x20]*[^\x00-\x7f][^\x00-\x20]*")
#: Runs without ASCII marks.
PIECE = regex.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Marks that properly begin and end words.
BEFORE, AFTER = "«“‘„¿¡–—… ", "»”’…–—。、€° "
OPENING, CLOSING = "([{<\"'", ".,;:!?)]}>\"'"
PARTS = regex.compile(r"[\p{L}\p{M}’“”‘„…]+")
FIGURES = regex.compile(r"\d+")
#: A word with the typographic marks that touch it, which change with the encoding as letters do.
MARKED = regex.compile(APART[0] + r"[\p{L}\p{M}’“”‘„…]++" + APART[1])
MARKS = str.maketrans("", "", "’“”‘„…")
HAN = regex.compile(r"[\p{Han}ｦ-ﾟ\p{Hiragana}\p{Katakana}]")
WIDE_RUN = regex.compile(r"[^\x00-\x7f�]{2,}")
LETTERS = regex.compile(r"[\p{L}\p{M}]+")
#: Part that sequences must cover of a stretch of non-ASCII characters that some encoding reads bytes as (scripts without
#: blanks have proper text beside it), so that chance pairs in proper words do not count; and adjacent sequences of one
#: encoding and script that need no cover.
COVERED, CHAIN = 0.6, 3
#: Tokens and words a worker remembers; forgetting them changes nothing.
KEPT_TOKENS = 200_000


@lru_cache(maxsize=64)
def table_of(encoding: str) -> tuple[str, ...]:
    """The character of each byte; bytes without one stand for the control character of that number, as lax readers do."""
    return tuple(bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256))


@lru_cache(maxsize=64)
def bytes_of(encoding: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(table_of(encoding))))}


def misread(text: str, written: str, read: str) -> str | None:
    """`text` written in one encoding and read in another; None if it cannot be written so."""
    if written == "utf_8" or written in JAPANESE:
        try:
            raw = text.encode(written)
        except UnicodeEncodeError:
            return None
    else:
        own = bytes_of(written)
        if any(c not in own for c in text):
            return None
        raw = bytes(own[c] for c in text)
    if read in WIDE:
        return raw.decode(read, "replace")
    t = table_of(read)
    return "".join(t[b] for b in raw)


WRITABLE = frozenset(c for e in LEGACY for c in table_of(e))


@lru_cache(maxsize=KEPT_TOKENS)
def _words_of_token(token: str) -> frozenset[str]:
    found = {w for w in WORD.findall(token)} | {w for w in MARKED.findall(token)}
    core = token.lstrip(BEFORE + OPENING).rstrip(AFTER + CLOSING)
    for p in [core, *PIECE.findall(token)]:
        found |= {p, p.lstrip(BEFORE).rstrip(AFTER), FIGURES.sub("0", p)}
    return frozenset(w for w in found if not w.isascii() and WRITABLE.issuperset(w))


def words_of(text: str) -> set[str]:
    """Words with a character outside ASCII that a one-byte encoding can write or give: words of letters, with and without
    the typographic marks at them, and whatever stands between ASCII marks. Of any length."""
    return set().union(*map(_words_of_token, set(TOKEN.findall(text))))


def _plain(word: str) -> bool:
    """Letters of one script in one of the usual cases, or a token with figures or signs among its few odd characters."""
    core = "".join(c for c in word.translate(MARKS) if c.isalpha())
    scripts = {0 if ord(c) < 0x370 else 1 if ord(c) < 0x400 else 2 if ord(c) < 0x530 else 3 for c in core}
    return not core or len(scripts) == 1 and (core.islower() or core.isupper() or core.istitle() or core[1:].islower() or scripts == {3})


# --- UTF-8 read in a one-byte encoding ---------------------------------------------------------------------------------

#: Characters that count by themselves, whatever the corpus holds: Latin letters, typographic marks and usual signs, and
#: the control characters that twice read text goes through.
USUAL = frozenset(chr(c) for a, z in ((0x80, 0x180), (0x218, 0x21C), (0x2010, 0x2045), (0x20A0, 0x20C0), (0x2100, 0x2190), (0x2190, 0x2200), (0xFEFF, 0xFF00), (0x1F000, 0x20000)) for c in range(a, z)) | frozenset(c for e in ("cp1250", "cp1251", "mac_roman") for c in table_of(e)[128:])


@lru_cache(maxsize=1)
def _continuations() -> dict[str, list[tuple[int, int]]]:
    """Character to (byte, encodings that read that byte so as bits), for bytes 0x80 to 0xBF."""
    out: dict[str, dict[int, int]] = {}
    for i, e in enumerate(READ_UTF8_AS):
        t = table_of(e)
        for b in range(0x80, 0xC0):
            at = out.setdefault(t[b], {})
            at[b] = at.get(b, 0) | 1 << i
    return {c: list(x.items()) for c, x in out.items()}


@lru_cache(maxsize=1)
def _utf8_automaton() -> ahocorasick.Automaton:
    """First two characters of what a UTF-8 sequence is read as, with (first byte, second byte, encodings as bits)."""
    found: dict[str, dict[tuple[int, int], int]] = {}
    for i, e in enumerate(READ_UTF8_AS):
        t = table_of(e)
        for lead in range(0xC2, 0xF5):
            for cont in range({0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80), {0xED: 0xA0, 0xF4: 0x90}.get(lead, 0xC0)):
                at = found.setdefault(t[lead] + t[cont], {})
                at[lead, cont] = at.get((lead, cont), 0) | 1 << i
    auto = ahocorasick.Automaton()
    for g, ways in found.items():
        auto.add_word(g, tuple((*bytes_, bits) for bytes_, bits in ways.items()))
    auto.make_automaton()
    return auto


@lru_cache(maxsize=8192)
def _script(c: str) -> str | None:
    """The script of a character, None for one that is not assigned. Ideographs, kana and their marks are one."""
    k = unicodedata.category(c)
    if k in ("Cn", "Co", "Cs"):
        return None
    n = ord(c)
    if n >= 0x2E80 and (n < 0xA000 or 0xF900 <= n < 0xFB00 or 0xFE30 <= n < 0xFE50 or 0xFF00 <= n < 0xFFF0 or n >= 0x20000):
        return "CJK"
    return unicodedata.name(c, "?").split()[0] if k[0] in "LM" else "sign"


def _decode(text: str, a: int, ways) -> Iterator[tuple[int, str, int]]:
    """(end, character, encodings) of the sequences that may begin at `a`."""
    follow = _continuations()
    for lead, cont, bits in ways:
        if lead < 0xE0:
            yield a + 2, chr((lead & 31) << 6 | cont & 63), bits
            continue
        codes = [((lead & (15 if lead < 0xF0 else 7)) << 6 | cont & 63, bits)]
        for k in range(1 if lead < 0xF0 else 2):
            c = text[a + 2 + k] if a + 2 + k < len(text) else None
            codes = [(n << 6 | b & 63, x & y) for n, x in codes for b, y in follow.get(c, ()) if x & y]
        for n, x in codes:
            yield a + (3 if lead < 0xF0 else 4), chr(n), x


STRETCH = regex.compile("[" + regex.escape("".join(sorted({c for e in READ_UTF8_AS for c in table_of(e) if not c.isascii()})), special_only=False) + "]+")


# --- Japanese legacy encodings ----------------------------------------------------------------------------------------

KANA = [chr(c) for a, z in ((0x3041, 0x3094), (0x30A1, 0x30F7)) for c in range(a, z)]
KANA_SET = frozenset(KANA) | set("、。ー「」")


def _japanese_automaton(ideographs: list[str]) -> ahocorasick.Automaton:
    """What kana and the given ideographs are read as, with the pairs of encodings."""
    found: dict[str, set[tuple[int, int]]] = {}
    for c in [*KANA, *ideographs]:
        for i, w in enumerate(JAPANESE):
            for j, r in enumerate(LEGACY):
                g = misread(c, w, r)
                if g and len(g) == 2:
                    found.setdefault(g, set()).add((i, j))
    auto = ahocorasick.Automaton()
    for g, pairs in found.items():
        auto.add_word(g, tuple(pairs))
    auto.make_automaton()
    return auto


def _japanese_run(token: str, at: int, written: str, read: str) -> tuple[int, int, str, int, int]:
    """(begin, end, decoded, characters of two bytes, kana among them) of the run around a match at `at`."""
    own = bytes_of(read)

    def two(i: int) -> str | None:
        pair = token[i : i + 2]
        if i < 0 or len(pair) < 2 or pair[0] not in own or pair[1] not in own:
            return None
        try:
            c = bytes([own[pair[0]], own[pair[1]]]).decode(written)
        except UnicodeDecodeError:
            return None
        return c if len(c) == 1 and _script(c) in ("CJK", "sign") else None

    a = z = at
    left, right, n, kana = [], [], 0, 0
    while z < len(token):
        c = two(z)
        if c is None and (token[z].isalpha() or not token[z].isascii()):
            break
        right.append(c or token[z])
        n, kana, z = n + (c is not None), kana + (c in KANA_SET), z + (2 if c else 1)
    while a > 0:
        c = two(a - 2) if not token[a - 2 : a].isascii() else None
        if c is None and (token[a - 1].isalpha() or not token[a - 1].isascii()):
            break
        left.append(c or token[a - 1])
        n, kana, a = n + (c is not None), kana + (c in KANA_SET), a - (2 if c else 1)
    while left and token[a].isascii():  # ASCII at the ends is not part of the run
        left.pop()
        a += 1
    while right and token[z - 1].isascii() and right[-1] == token[z - 1]:
        right.pop()
        z -= 1
    return a, z, "".join(left[::-1] + right), n, kana


def _wide_run(run: str, held: frozenset[str]) -> str | None:
    """UTF-8 that was read in an encoding of ideographs, or EUC-JP read as cp932, put right; None if it was not. What
    comes out must be CJK text or characters of the corpus, as short proper words can be UTF-8 of rare letters by chance."""
    narrow = sum("ｦ" <= c <= "ﾟ" for c in run)
    for read, written in [*((e, "utf_8") for e in WIDE), *([("cp932", "euc_jp")] if 3 * narrow >= len(run) else [])]:
        back = run.encode(read, "replace").decode(written, "replace")
        core = back.strip(LOST)  # a run between lost bytes may begin and end within characters
        good = sum(_script(c) == "CJK" or c in held for c in core if c not in LOST + "?")
        lost = core.count(LOST) + core.count("?")
        if good >= 2 and good + lost == len(core) and lost <= len(core) / 5 and back != run and (written == "utf_8" or 3 * sum(c in KANA_SET for c in core) >= len(core)):
            return back
    return None


# --- one legacy encoding read as another ------------------------------------------------------------------------------


def garbled_forms(word: str) -> dict[str, tuple[int, int]]:
    """Garbled form of a word to (changed characters, pairs of encodings as bits)."""
    out: dict[str, tuple[int, int]] = {}
    for i, written in enumerate(LEGACY):
        for j, read in enumerate(LEGACY):
            g = misread(word, written, read) if read != written else None
            if g and g != word and not g.isascii():
                out[g] = (sum(a != b for a, b in zip(g, word)), out.get(g, (0, 0))[1] | 1 << (i * len(LEGACY) + j))
    return out


def _proof(word: str) -> bool:
    """Short words prove nothing by themselves."""
    return len(word) > 3 or sum(not c.isascii() for c in word) > 2


def _parts(form: str) -> list[str]:
    return [form, *(p for p in PARTS.findall(form) if len(p) > 3 and p != form)]


def word_sequences(counts: dict[str, int]) -> dict[str, tuple[str, int, int, bool]]:
    """Garbled form to (word, changed characters, pairs of encodings as bits, proof), for every pair of legacy encodings
    and all words of `counts`; of several words with one form the most frequent."""
    out: dict[str, tuple[str, int, int, bool]] = {}
    for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if n < LEAST_DOCUMENTS or not _plain(w):
            continue
        for g, (changed, pairs) in garbled_forms(w).items():
            if g not in out and max(counts.get(p, 0) for p in _parts(g)) * MORE_FREQUENT <= n:
                out[g] = (w, changed, pairs, _proof(w))
    return out


def _turn_back(token: str, pair: int) -> str | None:
    """A token put right by a pair of encodings; None where that gives no plain token."""
    written, read = LEGACY[pair // len(LEGACY)], LEGACY[pair % len(LEGACY)]
    own = bytes_of(read)
    if any(c not in own for c in token):
        return None
    t = table_of(written)
    back = "".join(t[own[c]] for c in token)
    return back if back != token and _plain(back) and not any(c < " " or "\x7f" <= c < "\xa0" for c in back) else None


class Finder:
    """Finds and replaces garbled spans.

    `characters` are those the corpus holds properly; `forms` as word_sequences gives them and `proper`, the dictionary
    without the garbled forms, or `counts` to make both from."""

    def __init__(self, characters: list[str], counts: dict[str, int] | None = None, forms: dict | None = None, proper: set[str] | None = None):
        if counts is not None:
            forms = word_sequences(counts)
            proper = {w for w, n in counts.items() if n >= LEAST_DOCUMENTS and w not in forms}
        self.proper = proper or set()
        self.known = USUAL | frozenset(characters)
        self.held = frozenset(characters)
        self.utf8 = _utf8_automaton()
        self.japanese = _japanese_for(tuple(sorted(c for c in self.held if "㐀" <= c <= "鿿")))
        self.words = ahocorasick.Automaton()
        for g, (w, changed, pairs, proof) in (forms or {}).items():
            if proof:
                self.words.add_word(g, (len(g), w, changed, pairs))
        if len(self.words):
            self.words.make_automaton()
        self.kept: dict[str, tuple] = {}

    def _token(self, token: str) -> tuple[list, list, list, list]:
        """(spans, weak spans, scripts of chains, words) of one token. Spans are (begin, end, replacement, garbled
        characters), weak ones and words have more: the script and encodings that would prove them, or the pairs of encodings."""
        if token in self.kept:
            return self.kept[token]
        spans, singles, weak, chains, words = [], [], [], [], []
        taken = np.zeros(len(token) + 1, bool)
        self._utf8_units(token, spans, singles, weak, chains)
        for a, z, *_ in spans:
            taken[a:z] = True
        self._japanese_spans(token, spans, taken)  # runs prove more than sequences that stand alone
        for a, z, *rest in singles:
            if not taken[a:z].any():
                spans.append((a, z, *rest))
                taken[a:z] = True
        if len(self.words):
            hits = [(end + 1 - size, end + 1, to, changed, pairs) for end, (size, to, changed, pairs) in self.words.iter(token)]
            for w in sorted(hits, key=lambda w: (w[0] - w[1], w[0])):
                a, z = w[:2]
                if not taken[a:z].any() and not (a and WORD_CHARACTER.match(token[a - 1]) or z < len(token) and WORD_CHARACTER.match(token[z])):
                    words.append(w)
                    taken[a:z] = True
        if len(self.kept) >= KEPT_TOKENS:
            self.kept.clear()
        self.kept[token] = out = spans, weak, chains, words
        return out

    def _utf8_units(self, token: str, spans: list, singles: list, weak: list, chains: list) -> None:
        ways: dict[int, list] = {}
        for end, pairs in self.utf8.iter(token):
            a = end - 1
            for z, c, bits in _decode(token, a, pairs):
                script = _script(c)
                if script:
                    single = c in self.held or c in self.known and not self._proper_pair(token[a:z])
                    ways.setdefault(a, []).append((a, z, c, z - a, bits, script, single))
        if not ways:
            return
        # of the sequences that begin at a place the longest; known characters first, then the encodings listed first
        units, at = [], 0
        for a in sorted(ways):
            if a >= at:
                u = max(ways[a], key=lambda u: (self._goes_on(u, ways), u[6], u[1], -(u[4] & -u[4])))
                units.append(u)
                at = u[1]
        for k, u in enumerate(units):  # letters that could be a proper word's, next to a sequence that could not
            if not u[6] and u[2] in self.known and any(o[6] and u[4] & o[4] and u[0] <= o[1] and o[0] <= u[1] for o in units[max(0, k - 1) : k + 2]):
                units[k] = (*u[:6], True)
        chained = [False] * len(units)
        i = 0
        while i < len(units):  # chains: adjacent, one encoding, one script besides signs
            j, bits, script = i + 1, units[i][4], units[i][5]
            while j < len(units) and units[j - 1][1] == units[j][0] and bits & units[j][4] and (script == "sign" or units[j][5] in (script, "sign")):
                bits &= units[j][4]
                script = units[j][5] if script == "sign" else script
                j += 1
            part = units[i:j]
            words_too = all(self._proper_pair(token[u[0] : u[1]]) for u in part)  # then signs prove nothing
            if j - i >= CHAIN and (all(u[5] == script for u in part) and script != "sign" if words_too else script != "sign" or all(u[6] for u in part)):
                chained[i:j] = [True] * (j - i)
                chains.append((script, bits))
            i = j
        cover = np.zeros(len(token) + 1, np.int32)
        for u, c in zip(units, chained):
            if c or u[6]:
                cover[u[0] : u[1]] = 1
        sure = np.concatenate([[0], np.cumsum(cover)])
        for u in units:
            cover[u[0] : u[1]] = 1
        every = np.concatenate([[0], np.cumsum(cover)])
        good, fair = np.zeros(len(token) + 1, bool), np.zeros(len(token) + 1, bool)
        for m in STRETCH.finditer(token):
            a, z = m.span()
            good[a:z] = sure[z] - sure[a] >= COVERED * (z - a)
            fair[a:z] = every[z] - every[a] >= COVERED * (z - a)
        for u, c in zip(units, chained):
            if c:
                spans.append(u[:4])
            elif u[6] and good[u[0]]:
                singles.append(u[:4])
            elif fair[u[0]]:
                weak.append((*u[:4], u[5], u[4]))

    @staticmethod
    def _proper_pair(garbled: str) -> bool:
        """Letters of one script other than Latin: what stands in proper words of that script."""
        return len({s := _script(c) for c in garbled}) == 1 and s not in (None, "sign", "LATIN", "CJK")

    @staticmethod
    def _goes_on(unit: tuple, ways: dict) -> bool:
        """Whether a sequence of the same encoding and script follows."""
        return any(unit[4] & n[4] and (n[5] == unit[5] or "sign" in (n[5], unit[5])) for n in ways.get(unit[1], ()))

    def _japanese_spans(self, token: str, spans: list, taken: np.ndarray) -> None:
        tried: set[tuple] = set()
        found = []
        for end, pairs in self.japanese.iter(token):
            if taken[end - 1 : end + 1].any():
                continue
            for i, j in pairs:
                if any(p == (i, j) and a <= end - 1 < z for p, a, z in tried):
                    continue
                a, z, back, n, kana = _japanese_run(token, end - 1, JAPANESE[i], LEGACY[j])
                tried.add(((i, j), a, z))
                proven = kana >= 3 and 4 * kana >= n or all(c in self.held for c in back if not c.isascii())
                if LETTERS.fullmatch(token, a, z):  # may be a proper word: three hiragana, and nothing the corpus does not hold
                    proven = sum("ぁ" <= c <= "ん" for c in back) >= 3 and all(c in self.held for c in back)
                if n >= CHAIN and proven:
                    found.append((kana >= 2, z - a, -i, -j, a, z, back))
        for _, _, _, _, a, z, back in sorted(found, reverse=True):
            if not taken[a:z].any():
                spans.append((a, z, back, sum(not c.isascii() for c in token[a:z])))
                taken[a:z] = True
        if HAN.search(token):
            for m in WIDE_RUN.finditer(token):
                if not taken[m.start() : m.end()].any() and (back := _wide_run(m.group(), self.held)) is not None:
                    spans.append((m.start(), m.end(), back, m.end() - m.start()))
                    taken[m.start() : m.end()] = True

    def spans(self, text: str) -> list[tuple[int, int, str, int]]:
        """(begin, end, replacement, garbled characters), in order and apart."""
        if text.isascii():
            return []
        out, weak, chains, lines, tokens = [], [], [], {}, []
        for m in TOKEN.finditer(text):
            at = m.start()
            found = self._token(m.group())
            if not any(found):
                continue
            out += [(a + at, z + at, to, n) for a, z, to, n in found[0]]
            weak += [(a + at, z + at, to, n, script, bits) for a, z, to, n, script, bits in found[1]]
            chains += found[2]
            for a, z, to, n, pairs in found[3]:
                out.append((a + at, z + at, to, n))
                lines.setdefault(text.rfind("\n", 0, at) + 1, []).append(pairs)
        if weak and chains:
            out += [w[:4] for w in weak if any(bits & w[5] and script == w[4] for script, bits in chains)]
        if lines:
            taken = np.zeros(len(text) + 1, bool)
            for a, z, _, _ in out:
                taken[a:z] = True
            for begin, found in lines.items():
                out += self._rest_of_line(text, begin, found, taken)
        out.sort()
        return [s for i, s in enumerate(out) if not i or s[0] >= max(o[1] for o in out[max(0, i - 8) : i])] if weak and chains else out

    def _rest_of_line(self, text: str, begin: int, found: list[int], taken: np.ndarray) -> list[tuple[int, int, str, int]]:
        """Words too short or rare for the dictionary, in a line whose garbled words tell the pair of encodings."""
        votes = [sum(f >> k & 1 for f in found) for k in range(len(LEGACY) ** 2)]
        pair = int(np.argmax(votes))
        end = text.find("\n", begin)
        out = []
        for m in TOKEN.finditer(text, begin, end if end >= 0 else len(text)):
            token = m.group()
            core = token.lstrip(BEFORE + OPENING).rstrip(AFTER + CLOSING)
            if core.isascii() or taken[m.start() : m.end()].any() or FIGURES.sub("0", core) in self.proper:
                continue
            words = [w for w in MARKED.findall(core) if not w.isascii()]
            if words and all(w in self.proper for w in words):
                continue
            back = _turn_back(token, pair)
            if back is not None:
                out.append((m.start(), m.end(), back, sum(a != b for a, b in zip(token, back))))
                taken[m.start() : m.end()] = True
        return out

    def garbled(self, text: str) -> int:
        """Garbled characters, replacement characters among them."""
        return sum(s[3] for s in self.spans(text)) + text.count(LOST)

    def restore(self, text: str) -> str:
        """The text with matched spans put right, again while that brings out further spans; ends where a text comes again."""
        seen = set()
        while text not in seen:
            seen.add(text)
            found = self.spans(text)
            parts, at = [], 0
            for a, z, to, _ in found:
                parts += [text[at:a], to]
                at = z
            text = "".join(parts) + text[at:]
        return text


@lru_cache(maxsize=2)
def _japanese_for(ideographs: tuple[str, ...]) -> ahocorasick.Automaton:
    return _japanese_automaton(list(ideographs))


# --- the dictionary, distributed --------------------------------------------------------------------------------------

ODD = r"[^\x00-\x7F]"


def _count_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word, token, n): partial counts of the documents each word, by block, and each character outside ASCII is in."""
    words: Counter = Counter()
    characters: Counter = Counter()

    def out():
        keys = [*words, *((-1, c) for c in characters)]
        n = [*words.values(), *characters.values()]
        cols = [pa.array([k[0] for k in keys], pa.int32()), pa.array([True] * len(words) + [False] * len(characters), pa.bool_()), pa.array([k[1] for k in keys], pa.string()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["block", "word", "token", "n"])

    for b in batches:
        for block, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words.update([(block, w) for w in words_of(text)])
            characters.update({c for c in set(text) if not c.isascii()})
        if len(words) > 200_000:
            yield out()
            words.clear()
            characters.clear()
    if words or characters:
        yield out()


COUNTED = "block int, word boolean, token string, n long"


def corpus_counts(df: DataFrame, text: str) -> tuple[list[str], dict[str, int]]:
    """Characters outside ASCII by falling number of documents, and the whole dictionary, as a model to be given to
    `find_garbled` by hand. `find_garbled` itself never brings the dictionary together."""
    odd = df.select(F.lit(0).alias("block"), text).filter(F.col(text).rlike(ODD))
    counts = odd.mapInArrow(_count_batch, COUNTED).groupBy("word", "token").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts.filter(F.col("n") >= LEAST_DOCUMENTS))
    words = counts.filter("word").orderBy(F.desc("n"), "token").collect()
    return _characters(counts), {r["token"]: r["n"] for r in words}


def _characters(counts: DataFrame) -> list[str]:
    """At most as many as Unicode has."""
    return [r["token"] for r in counts.filter(f"not word and n >= {LEAST_DOCUMENTS}").orderBy(F.desc("n"), "token").select("token").collect()]


def _garble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if _plain(w):
                for g, (changed, pairs) in garbled_forms(w).items():
                    for o, x in zip(out, (g, w, n, changed, format(pairs, "x"))):
                        o.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()))], names=["form", "w", "n", "changed", "pairs"])


def _form_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = [_parts(g) for g in b.column(0).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([p for x in parts for p in x], pa.string())], names=["form", "token"])


def block_dictionaries(counted: DataFrame) -> DataFrame:
    """(block, token, w, changed, pairs): for each block the garbled forms among its words, with the word each stands for,
    and, with null `w`, the proper dictionary words; only for blocks that hold a form. `counted` is (block, token, n).

    All joins are on words; a form is looked up among the words that occur, so what goes on is as large as the garbled part of the corpus.
    """
    vocabulary = checkpointed(counted.groupBy("token").agg(F.sum("n").alias("n")))
    held = vocabulary.filter(F.col("n") >= LEAST_DOCUMENTS)
    dealt = held.select("token", "n").repartition(2 * cores(counted.sparkSession))  # few bytes, much work: not to be merged
    forms = dealt.mapInArrow(_garble, "form string, w string, n long, changed int, pairs string")
    met = checkpointed(forms.join(vocabulary.select(F.col("token").alias("form")), "form", "left_semi"))
    parts = met.select("form").distinct().mapInArrow(_form_parts, "form string, token string")
    most = parts.join(vocabulary, "token").groupBy("form").agg(F.max("n").alias("most"))
    kept = met.join(most, "form").filter(F.col("most") * MORE_FREQUENT <= F.col("n"))
    best = kept.groupBy("form").agg(F.min(F.struct((-F.col("n")).alias("m"), "w", "changed", "pairs")).alias("b"))
    best = checkpointed(best.select(F.col("form").alias("token"), "b.w", "b.changed", "b.pairs"))
    here = checkpointed(counted.select("block", "token").join(best, "token"))
    blocks = here.select("block").distinct()
    proper = counted.select("block", "token").join(blocks, "block", "left_semi").join(held.select("token"), "token", "left_semi").join(best.select("token"), "token", "left_anti")
    return here.unionByName(proper.select("block", "token", F.lit(None).cast("string").alias("w"), F.lit(None).cast("int").alias("changed"), F.lit(None).cast("string").alias("pairs")))


_FINDERS: dict[str, Finder] = {}


def _finder(name: str, shared) -> Finder:
    """One automaton for each Python worker and model."""
    if name not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[name] = Finder(*shared.value)
    return _FINDERS[name]


def _judge(finder: Finder, keys: pa.Array, texts: list[str], restore: bool) -> list[pa.Array]:
    n = np.array([finder.garbled(t) for t in texts], np.int64)
    hit = np.flatnonzero(n >= LEAST_GARBLED)
    cols = [keys.take(pa.array(hit)), pa.array(n[hit])]
    if restore:
        cols.append(pa.array([finder.restore(texts[i]) for i in hit], pa.string()))
    return cols


def find_garbled(df: DataFrame, key: str, text: str, restore: bool = False, model=None) -> DataFrame:
    """(`key`, garbled[, restored]) of the rows with LEAST_GARBLED garbled characters or more.

    Null, empty and pure ASCII texts are never cases. `restored` has matched spans put right; characters that were lost
    stay as they are. `df` is read twice: words are counted by block, then the texts go to their blocks, one shuffle of
    the texts outside ASCII. A block holds a quarter of an input split or less, however few splits there are. With
    `model`, a pair of characters and word counts that corpus_counts gave, nothing is counted or shuffled.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    names = [key, "garbled", "restored"][: 2 + restore]
    schema = f"`{key}` {kind}, garbled long" + ", restored string" * restore
    rows = df.select(key, text).filter(F.col(text).rlike(ODD))
    if model is not None:
        shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = _finder(name, shared)
            for b in batches:
                yield pa.RecordBatch.from_arrays(_judge(finder, b.column(0), b.column(1).to_pylist(), restore), names=names)

        return rows.mapInArrow(run, schema)
    blocks = max(4 * cores(spark), 8 * df.rdd.getNumPartitions())
    placed = rows.withColumn("__block", F.pmod(F.xxhash64(key, text), F.lit(blocks)).cast("int"))
    counted = placed.select("__block", text).mapInArrow(_count_batch, COUNTED).groupBy("block", "word", "token").agg(F.sum("n").alias("n"))
    counted = checkpointed(counted)
    characters = spark.sparkContext.broadcast(_characters(counted))
    dictionary = block_dictionaries(counted.filter("word").select("block", "token", "n"))

    def judge(_, docs, words):
        token, w, changed, pairs = (words.column(c).to_pylist() for c in ("token", "w", "changed", "pairs"))
        forms = {g: (x, c, int(p, 16), _proof(x)) for g, x, c, p in zip(token, w, changed, pairs) if x is not None}
        finder = Finder(characters.value, forms=forms, proper={g for g, x in zip(token, w) if x is None})
        keys = docs.column(key)
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        return pa.Table.from_arrays(_judge(finder, keys, docs.column(text).to_pylist(), restore), names=names)

    return placed.groupBy("__block").cogroup(dictionary.groupBy("block")).applyInArrow(judge, schema)
