"""What one pass over a text finds: its normalised form with offsets, sentences, numbers, pattern hits.

These are the only pieces of the extraction that run in Python; a row's hits come back as arrays, and
what follows from them (dates, classification, attribution, records) is done in column expressions.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Collection, Iterable, Iterator
from itertools import accumulate
from operator import itemgetter

import regex

from ..sources.catalog import Catalog
from .turkish import APOSTROPHES, INVISIBLE

LETTER = r"[^\W\d_]"
# Abbreviations whose dot ends no sentence.
ABBREVIATIONS = set("dr doç prof op av sn sy no nu vb vs bkz örn yy sf md krş alb gen yzb ütğm tğm mah cad sok apt blv tel st".split())
ABBREVIATION_ENDS = {a[-2:] for a in ABBREVIATIONS}
TERMINATOR = re.compile(r"[.!?…]+")
# Number words.
WORDS = {w: n for n, w in enumerate("sıfır bir iki üç dört beş altı yedi sekiz dokuz".split())}
TENS = {w: 10 * n for n, w in enumerate("on yirmi otuz kırk elli altmış yetmiş seksen doksan".split(), 1)}
SCALES = {"yüz": 100, "bin": 10**3, "milyon": 10**6, "milyar": 10**9}
LARGEST = 2**63 - 1
# Dates and road codes, whose figures are no counts.
NOT_NUMBERS = re.compile(r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}")
ROUTE_CODE = re.compile(rf"(?a:\b){LETTER}{{1,3}}-[0-9]+(?a:\b)")
DIVIDED, HYPHENED = re.compile(r"[./-](?<=[0-9][./-])[0-9]"), re.compile("-[0-9]")
FIGURE = re.compile(r"[0-9](?:[0-9]{0,2}(?:\.[0-9]{3})+|[0-9]*(?P<decimal>,[0-9]+)?)")
#: What each number word is worth and its rank (see Sum.then), and where it is a whole run of letters; patterns that
#: begin with plain letters are searched far more quickly.
WORTH = {w: (n, rank) for rank, words in ((0, WORDS), (1, TENS), (None, SCALES)) for w, n in words.items()}
WHOLE = {w: re.compile(rf"{w}(?<!{LETTER}{w})(?!{LETTER})") for w in WORTH}
# Month names, the endings that time words take, and phrases that shift the date.
MONTHS = "ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık".split()
TIME_ENDING = "(?:l[ıi]k|l[ae]r[ıi]nd[ae]|t[ae]|d[ae]|k[iıuü]|[ıiuü]n)?"


def begun(*words: str) -> str:
    """Words at a word's boundary, which is looked for behind their plain letters, by which they are found quickly."""
    return f"(?:{'|'.join(rf'{w}(?<=\b{w})' for w in words)})"


#: A digit at a word's boundary, found quickly in the same way.
FIRST_DIGIT = r"\d(?<=\b\d)"
DATE_PATTERNS = {
    "ISO": rf"({FIRST_DIGIT}\d{{3}})-(\d{{1,2}})-(\d{{1,2}})\b",
    "NUMERIC": rf"({FIRST_DIGIT}\d?)[./-](\d{{1,2}})[./-](\d{{2,4}})\b",
    "NAMED": rf"({FIRST_DIGIT}\d?)\s+({'|'.join(MONTHS)})(?:'{LETTER}+)?(?:\s+(\d{{4}}))?",
    "-2d": rf"{begun('önceki', 'evvelki')}\s+gün\b",
    "-7d": rf"{begun('geçen', 'geçtiğimiz')}\s+hafta{TIME_ENDING}\b",
    "-1m": rf"{begun('geçen', 'geçtiğimiz')}\s+ay{TIME_ENDING}\b",
    "-1d": rf"{begun('dün')}(?:kü|den|e)?\b",
    "0d": rf"{begun('bugün')}(?:kü|den|e|lerde)?\b",
    "+0d": rf"{begun('bu')}\s+(?:hafta|sabah|akşam|gece){TIME_ENDING}\b",
    "window": rf"{begun('son')}\s+(?:\d{{1,3}}|{LETTER}+(?:\s+{LETTER}+)?)\s+(?:saat|gün|hafta|ay){TIME_ENDING}\b",
}
# Endings of province names, words that make a name a district, endings of keywords.
PROVINCE_ENDING = "(?:'?(?:nd[ae]n|nd[ae]|d[ae]n|t[ae]n|n[ıiuü]n|[ıiuü]nd[ae]|d[ae]|t[ae]|l[ıi]|y[ae]|[ae]))?"
DISTRICT = re.compile(rf"\s*(?:ilçe|semt|mahalle|belde|köy|bucak|beldesi){LETTER}*\b")
KEYWORD_ENDING = (
    "(?:l[ae]r|l[ıiuü]k?|d[aeıiuü]n?|t[aeıiuü]n?|[ae]rken|[ae]r[ae]k|[ıiuü]nc[ae]|n[ıiuü]n|nd[ae]n?|n[ıiuü]|s[ıiuü]"
    "|[ıiuü]yor|m[ae]k|m[ıiuü]ş|[ae]n|y[ae]|[ıiuü]p|[ıiuü]n|[aeıiuü]){0,3}"
)
# Final consonants that soften, words that mark figures shared by provinces, and the ending
# of a circumstance.
SOFTENED = {"p": "b", "ç": "c", "t": "d", "k": "ğg"}
SHARING = ("iki", "üç", "dört", "beş", "altı")
# a class of first characters in front is found quickly; what follows it goes by which of them it was
SHARED_MARKER = (
    rf"[hiüdbaş\d](?<=\b.)(?:(?:(?<=h)er\s+(?:{'|'.join(SHARING)}|\d{{1,2}})|{'|'.join(f'(?<={w[0]}){w[1:]}' for w in SHARING)}|(?<=\d)\d?)\s+(?:il|şehir){LETTER}*"
    rf"|(?:(?<=i)l|(?<=ş)ehir)ler{LETTER}*)\b"
)
CIRCUMSTANCE = re.compile("(?:d[ae]|t[ae])$")
LETTERS = re.compile(rf"{LETTER}*")
CLUSTER = regex.compile(r"\X")
#: What may make a cluster of several characters, or counts as white space for Python alone; all others are
#: outside the ranges of SUSPECT, which are found more quickly.
SUSPECT = re.compile("[\r\x85\xad\u0300-\u200f\u202a-\u202e\u2060-\u206f\u20d0-\U0010ffff]")
NOT_PLAIN = regex.compile(r"[\p{M}\p{Cf}\r\x85\u1100-\u11FF\uA960-\uA97F\uD7B0-\uD7FF\U0001F1E6-\U0001F1FF\U0001F3FB-\U0001F3FF]")
RUN = re.compile(r"\S+")
DIGIT = re.compile(r"\d")
DIVIDED_DIGITS = re.compile(r"[./-](?<=\d[./-])\d")
# A piece of text without which a date pattern cannot match; "0" stands for any digit, "0/0" for digits
# with a sign of dates between them.
NEEDED = {"ISO": "0/0", "NUMERIC": "0/0", "NAMED": "0", "-2d": "gün", "-7d": "hafta", "-1m": "ay", "-1d": "dün", "0d": "bugün", "+0d": "bu", "window": "son"}


# Hints: patterns for Arrow, which searches a batch of texts at once, without which a text has no hit of a kind or no
# number. They only rule out, so they may match too much: what is beyond ASCII counts as whatever is looked for.
KINDS = ("DATE", "PROVINCE", "MARKER", "KEYWORD")
BEGIN, GAP, FIGURES, WORD = r"(?:^|[^0-9a-zçğıöşü_])", "[^0-9a-zçğıöşü_]+", r"[0-9\x{80}-\x{10FFFF}]", r"[0-9a-z\x{80}-\x{10FFFF}]+"
DATE_HINT = "|".join([
    f"{FIGURES}[./-]{FIGURES}", f"{FIGURES}{GAP}(?:{'|'.join(MONTHS)})", f"{BEGIN}(?:önceki|evvelki){GAP}gün", f"{BEGIN}(?:geçen|geçtiğimiz){GAP}(?:hafta|ay)", f"{BEGIN}(?:dün|bugün)",
    f"{BEGIN}bu{GAP}(?:hafta|sabah|akşam|gece)", f"{BEGIN}son{GAP}{WORD}(?:{GAP}{WORD})?{GAP}(?:saat|gün|hafta|ay)",
])
MARKER_HINT = f"(?:il|şehir)ler|(?:iki|üç|dört|beş|altı|{FIGURES}){GAP}(?:il|şehir)"
NUMBER_HINT = f"[0-9]|(?:^|[^a-zçğıöşü])(?:{'|'.join(WORTH)})(?:$|[^a-zçğıöşü])"


def begins(pieces: list[str]) -> str:
    """The hint of pieces that patterns look for behind a word's boundary."""
    return "|".join(f"{BEGIN if p[:1].isalnum() or p[:1] == '_' else ''}(?:{p})" for p in pieces)


def tr_lower(text: str) -> str:
    return text.replace("İ", "i").replace("I", "ı").lower()


def is_space(cluster: str) -> bool:
    return all(c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f" or unicodedata.category(c) in ("Zs", "Zl", "Zp") for c in cluster)


def folded(text: str) -> str:
    """Lower-cased, with one kind of apostrophe."""
    for c in APOSTROPHES:
        text = text.replace(c, "'")
    return tr_lower(text)


def plain(raw: str) -> bool:
    return not SUSPECT.search(raw) or not NOT_PLAIN.search(raw) and unicodedata.is_normalized("NFC", raw)


def normalised(raw: str) -> str:
    """The normalised text alone."""
    return " ".join(folded(raw).split()) if plain(raw) else _normalise_clusters(raw)[0]


def moved(raw: str, value: str) -> int | None:
    """How far all characters of the normalised text stand further on in its source, if all do by as much."""
    return len(raw) - len(raw.lstrip()) if plain(raw) and len(raw.strip()) == len(value) else None


def normalise(raw: str) -> tuple[str, list[int], list[int]]:
    """The normalised text and, for each of its characters, where its source begins and ends (code points)."""
    if not plain(raw):
        return _normalise_clusters(raw)
    text, words, begin, end = folded(raw), [], [], []
    if len(value := " ".join(text.split())) == len(raw):  # only single white space, within: every character stays where it is
        return value, list(range(len(raw))), list(range(1, len(raw) + 1))
    for m in RUN.finditer(text):
        if words:
            begin.append(end[-1])
            end.append(m.start())
        words.append(m[0])
        begin.extend(range(m.start(), m.end()))
        end.extend(range(m.start() + 1, m.end() + 1))
    return " ".join(words), begin, end


def _normalise_clusters(raw: str) -> tuple[str, list[int], list[int]]:
    out, begin, end = [], [], []
    for m in CLUSTER.finditer(raw):
        cluster = m[0]
        if is_space(cluster):
            if out and out[-1] == " ":
                end[-1] = m.end()
            elif out:
                out.append(" ")
                begin.append(m.start())
                end.append(m.end())
            continue
        folded = unicodedata.normalize("NFC", cluster)
        if len(folded) == 1:
            folded = "'" if folded in APOSTROPHES else "" if folded in INVISIBLE else folded
        for c in tr_lower(folded):
            out.append(c)
            begin.append(m.start())
            end.append(m.end())
    if out and out[-1] == " ":
        out.pop(), begin.pop(), end.pop()
    return "".join(out), begin, end


def sentences(value: str) -> list[tuple[int, int]]:
    """Where sentences begin and end; pieces without a letter or digit are none."""
    cuts, start = [], 0
    for m in TERMINATOR.finditer(value):
        at, stop = m.span()
        if stop < len(value) and not value[stop].isspace():
            continue
        # leading dots inside a number or after an abbreviation end nothing; what follows them may
        while at < stop and value[at] == ".":
            between = at > 0 and value[at - 1].isdigit() and at + 1 < len(value) and value[at + 1].isdigit()
            if not between and value[max(0, at - 2) : at] not in ABBREVIATION_ENDS:
                break
            word = at
            while word > start and at - word < 6 and value[word - 1].isalpha():
                word -= 1
            if not between and value[word:at] not in ABBREVIATIONS:
                break
            at += 1
        if at < stop:
            cuts.append((start, stop))
            start = stop
    cuts.append((start, len(value)))
    out = []
    for a, b in cuts:
        while a < b and value[a].isspace():
            a += 1
        while a < b and value[b - 1].isspace():
            b -= 1
        if a < b and (value[a].isalnum() or any(c.isalnum() for c in value[a:b])):
            out.append((a, b))
    return out


#: A number under construction: its closed segments, the open one, and what may still follow (below_rank,
#: below_scale, whether a hundred was named).
NOTHING = (0, 0, 3, LARGEST, False)


def then(number: tuple[int, int, int, int, bool], value: int, rank: int | None) -> tuple[int, int, int, int, bool] | None:
    """The number with one more part (rank 0 unit, 1 ten, 2 figure, None scale), or None where it doesn't fit."""
    closed, opened, below_rank, below_scale, hundred = number
    if rank is None and value == 100:
        grown = (opened or 1) * 100
        return None if hundred or grown > LARGEST else (closed, grown, 3, below_scale, True)
    if rank is None:
        total = closed + (part := (opened or 1) * value)
        return None if value >= below_scale or part > LARGEST or total > LARGEST else (total, 0, 3, value, False)
    fits = opened == 0 and below_rank == 3 if rank == 2 else rank < below_rank
    grown = opened + value
    return (closed, grown, -1 if rank == 2 else rank, below_scale, hundred) if fits and grown <= LARGEST else None


def number_parts(value: str) -> list[tuple[int | None, int | None, int, int]]:
    """(value, rank, begin, end) of figures and number words; a value of None is no count."""
    digits = DIGIT.search(value)
    veiling = [p for p, sign in ((NOT_NUMBERS, DIVIDED), (ROUTE_CODE, HYPHENED)) if sign.search(value)] if digits else []
    veiled = sorted(m.span() for p in veiling for m in p.finditer(value))
    found = [(*m.span(), *WORTH[w]) for w, pattern in WHOLE.items() if w in value for m in pattern.finditer(value)]
    for m in FIGURE.finditer(value) if digits else ():
        n = None if m.lastindex else int(m[0].replace(".", ""))
        found.append((m.start(), m.end(), None if n is None or n > LARGEST else n, 2))
    out, k, covered = [], 0, 0
    for a, b, n, rank in sorted(found, key=itemgetter(0)):
        # covered: where the veiled spans that begin before b end
        while k < len(veiled) and veiled[k][0] < b:
            covered = max(covered, veiled[k][1])
            k += 1
        if a >= covered:
            out.append((n, rank, a, b))
    return out


def numbers(value: str) -> list[tuple[int, int, int, str]]:
    """(value, begin, end, notation) of the counts in a text."""
    out, state, first, last, ranks, refused = [], None, 0, 0, [], False

    def close() -> None:
        if state:
            figures = [r == 2 for r in ranks]
            out.append((state[0] + state[1], first, last, "DIGITS" if all(figures) else "MIXED" if any(figures) else "WORDS"))

    parts = number_parts(value)
    for k, (n, rank, a, b) in enumerate(parts):
        near = value[last:a].isspace() or last == a and (state is not None or refused)
        if n is None:
            close()
            state, refused, last = None, True, b
        elif refused and near and rank is None:
            last = b
        elif rank == 2 and not near and (k + 1 == len(parts) or parts[k + 1][2] - b > 1 and not value[b : parts[k + 1][2]].isspace()):
            # a figure by itself
            close()
            out.append((n, a, b, "DIGITS"))
            state, refused, last = None, False, b
        else:
            refused = False
            longer = then(state, n, rank) if state and near else None
            if longer is None:
                close()
                state, first, ranks = then(NOTHING, n, rank), a, []
            else:
                state = longer
            ranks.append(rank)
            last = b
    close()
    return out


def keyword_pattern(keyword: str) -> re.Pattern:
    """A keyword, its last consonant hard or soft, with up to three endings. The word's boundary before it is looked
    for behind its plain letters, by which it is found quickly."""
    *front, word = normalise(keyword)[0].split()
    soft = SOFTENED.get(word[-1])
    stem = re.escape(word[:-1]) + f"[{word[-1]}{soft}]" if soft else re.escape(word)
    first = front[0] if front else word[:-1] if soft else word
    behind = rf"(?<=\b{re.escape(first)})" if first else ""
    rest = (r"\s+".join(["", *map(re.escape, front[1:]), stem]) if front else stem[len(re.escape(first)) :]) + KEYWORD_ENDING + r"\b"
    return re.compile((re.escape(first) + behind if first else r"\b") + rest)


#: Between texts that are searched together: no pattern matches across it, and a word's boundary is beside it as at a
#: text's ends.
BETWEEN = "\0"


class Together:
    """Texts joined to be searched in one go, and where each begins; ids: what they are called."""

    def __init__(self, values: list[str], ids: Iterable[int]):
        self.text, self.ids = BETWEEN.join(values), list(ids)
        self.starts = list(accumulate((len(v) + 1 for v in values[:-1]), initial=0))

    def placed(self, matches: Iterable[re.Match]) -> Iterator[tuple[re.Match, int, int, int]]:
        """Each match with its text and its span there."""
        for m in matches:
            a, b = m.span()
            k = bisect_right(self.starts, a) - 1
            yield m, self.ids[k], a - self.starts[k], b - self.starts[k]


def stems(keyword: str) -> tuple[str, ...]:
    """Pieces of text without which a keyword cannot occur."""
    *front, word = normalise(keyword)[0].split()
    return (*front, word[:-1] if word[-1] in SOFTENED else word)


class Scanner:
    """The compiled patterns of a catalog and a list of provinces. A pattern is tried only on texts that
    hold the plain pieces it needs, which is far quicker to find out, and once for all that share a keyword."""

    def __init__(self, catalog: Catalog, provinces: dict[int, str]):
        if not provinces:
            raise ValueError("no provinces to recognise")
        self.codes = {normalise(name)[0]: code for code, name in provinces.items()}
        # one pattern for all names: texts of ever new sets of names would have each compiled anew
        by_first = defaultdict(list)
        for name in sorted(self.codes, key=lambda n: (-len(n), n)):
            by_first[name[:1]].append(re.escape(name[1:]))
        names = "|".join(f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in by_first.items())
        self.provinces = re.compile(rf"\b({names}){PROVINCE_ENDING}\b")
        self.dates = [(n, k, NEEDED[k], re.compile(p)) for n, (k, p) in enumerate(DATE_PATTERNS.items())]
        self.marker = re.compile(SHARED_MARKER)
        self.details = {name: str(code) for name, code in self.codes.items()}
        self.triggers = [(e.key, n, str(k), w) for n, e in enumerate(catalog.event_types) for k, w in enumerate(e.keywords)]
        listed = [(e.key, m.key, w) for e in catalog.event_types for m in e.metrics for w in m.keywords]
        self.metrics = [(e, m, k, w) for k, (e, m, w) in enumerate(listed)]
        self.sizes = {w: len(normalise(w)[0]) for *_, w in self.metrics}
        self.keywords = {w: (frozenset(stems(w)), keyword_pattern(w)) for *_, w in self.triggers + self.metrics}
        #: For how many more pieces a kind's hint is not asked.
        self.idle: dict[str, int] = {}
        self.pieces = sorted(frozenset().union(*(need for need, _ in self.keywords.values())))
        self.hints = {
            "DATE": DATE_HINT, "MARKER": MARKER_HINT, "PROVINCE": begins(sorted(map(re.escape, self.codes))),
            "KEYWORD": begins(sorted({GAP.join(map(re.escape, stems(w))) for w in self.keywords})),
        }

    def hits(self, value: str, kinds: Collection[str] = KINDS) -> list[dict]:
        """Every pattern's hits: kind, key, detail, ord (of the pattern), begin, end. kinds: what the hints leave."""
        names = ("begin", "end", "ord", "kind", "key", "detail")
        return [dict(zip(names, h)) for h in self.hits_of([value], {kind: [0] for kind in kinds})[0]]

    def hits_of(self, values: list[str], left: dict[str, list[int]], all_metrics: bool = True) -> dict[int, list[tuple]]:
        """The hits of each text as tuples (begin, end, ord, kind, key, detail). left: the texts that the hints leave
        for a kind. Without all_metrics, only metrics of event types that the text has a trigger of."""
        out, made = defaultdict(list), {}

        def together(kind: str) -> Together | None:
            if not (some := left.get(kind)):
                return None
            key = tuple(some)
            if key not in made:
                made[key] = Together([values[k] for k in some], some)
            return made[key]

        if t := together("DATE"):
            signs = {"0": DIGIT.search(t.text) is not None, "0/0": DIVIDED_DIGITS.search(t.text) is not None}
            for n, key, need, pattern in self.dates:
                if signs[need] if need in signs else need in t.text:
                    for m, k, a, b in t.placed(pattern.finditer(t.text)):
                        out[k].append((a, b, n, "DATE", key, "|".join(g or "" for g in m.groups())))
        if t := together("PROVINCE"):
            for m, k, a, b in t.placed(self.provinces.finditer(t.text)):
                if not DISTRICT.match(t.text, m.end()):
                    out[k].append((a, b, 0, "PROVINCE", m[1], self.details[m[1]]))
        if (t := together("MARKER")) and ("il" in t.text or "şehir" in t.text):
            for _, k, a, b in t.placed(self.marker.finditer(t.text)):
                out[k].append((a, b, 0, "MARKER", "", ""))
        if not (t := together("KEYWORD")):
            return out
        words = " ".join(set(t.text.split()))  # pieces hold no white space
        there = {x for x in self.pieces if x in words}
        spans = {w: found for w, (need, pattern) in self.keywords.items() if need <= there and (found := list(t.placed(pattern.finditer(t.text))))}
        triggered = defaultdict(set)
        for event, type_ord, detail, w in self.triggers:
            for _, k, a, b in spans.get(w, ()):
                out[k].append((a, b, type_ord, "EVENT_TYPE", event, detail))
                triggered[event].add(k)
        counted = {w: [x[1:] for x in spans[w] if not CIRCUMSTANCE.search(LETTERS.match(t.text, x[0].start() + size)[0])] for w, size in self.sizes.items() if w in spans}
        for event, metric, n, w in self.metrics:
            those = triggered[event]
            for k, a, b in counted.get(w, ()):
                if all_metrics or k in those:
                    out[k].append((a, b, n, "METRIC", event, metric))
        return out
