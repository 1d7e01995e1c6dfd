"""A document's facts in one call: segmented, hit and counted in memory, without a row per line or sentence.

The same result as ``facts.by_rows``, whose constants and patterns it uses; a
pack with a pattern that Python's regex reads differently is left to that.
Sentences of a batch are judged together, and one that comes again is not
judged again.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterable
from functools import cache
from itertools import accumulate, chain, count, repeat
from operator import itemgetter, mul

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from penstrata.functions.text import CONTENT, PUNCTUATION, SPACE, WS
from penstrata.functions.windows import sums_of
from penstrata.operators import domain as d
from penstrata.operators import segment as g
from penstrata.operators.segment import Config
from penstrata.packs import Pack

#: Sentences that a worker remembers, and documents judged at a time: bounds of memory, not of the result.
REMEMBERED, SLICE = 50_000, 500
#: Rules search fewer sentences than this one by one.
FEW = 32
_ANY = "[^\n\r\x85\u2028\u2029]"
_SPACES = " \t\n\x0b\f\r"
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")


def translated(pattern: str) -> str | None:
    """A Java pattern as Python reads it, or null where the two may differ. ``.`` and white space are spelled out."""
    p = _ESCAPE.sub(lambda m: re.escape(chr(int(m[1], 16))), pattern)
    if re.search(r"\\(?:[^\W_dDwWs]|$)|&&|\[[^\]]*\[|\(\?(?![:=!])|\{,", p):
        return None
    out, inside, i = [], False, 0
    while i < len(p):
        step = 2 if p[i] == "\\" else 1
        inside = (inside or p[i] == "[") and p[i] != "]"
        one = p[i : i + step]
        if one == r"\s":
            one = _SPACES if inside else f"[{_SPACES}]"
        out.append(_ANY if one == "." and not inside else one)
        i += step
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            re.compile("".join(out), re.ASCII)
    except (re.error, Warning):
        return None
    return "".join(out)


def _line(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\p{Nd}", r"\d").replace(r"\P{Nd}", r"\D"))


_CONTENT = re.compile(CONTENT)
_FENCE, _HEADING, _RULE, _ITEM, _CHECKBOX, _QUOTED, _TABLE_RULE = (_line(p) for p in (g.FENCE, g.HEADING, g.RULE, g.ITEM, g.CHECKBOX, g.QUOTED, g.TABLE_RULE))
_CODE, _IMAGE, _LINK, _EMAIL, _EMPHASIS = (re.compile(p) for p in (g.CODE, g.IMAGE, g.LINK, g.EMAIL, g.EMPHASIS))
# letters of ASCII only, as in Java; Python would fold others into them
_URL = re.compile(g.URL.replace("(?i)(?:https?://|www\\.)", "(?:[hH][tT][tT][pP][sS]?://|[wW][wW][wW]\\.)"))
_BARS, _BLANKS = re.compile(r"^\|+|\|+$"), re.compile(r"[ \t]{2,}")
_QUOTE = re.compile(f'([{g.OPEN_QUOTES}{g.CLOSE_QUOTES}"])')
_BARE = str.maketrans("", "", PUNCTUATION + SPACE)
_CLAUSES = str.maketrans("", "", "".join(c for c in PUNCTUATION + SPACE if c not in d.COMMAS))
_COMMAS = re.compile(f"[{d.COMMAS}]")
_CJK = re.compile("[一-鿿]+")
_HEADS = tuple(d.OFFICIAL_HEADS)
#: A line without any of these is plain text and needs no other test.
_MARKED = re.compile(rf"^{WS}*[-+*#=_~\d]|[`\[*|@]|://|[wW]\.|[ \t]{{2,}}")
#: The same by look-up: a document without any of INLINE has marks only where a line starts.
_INLINE, _STARTS = ("`", "[", "*", "|", "@", "://", "w.", "W.", "  ", "\t"), frozenset("-+*#=_~")


def inline_clean(s: str) -> str:
    if "`" in s:
        s = _CODE.sub(r"\1", s)
    if "](" in s:
        s = _LINK.sub(r"\1", _IMAGE.sub(r"\1", s))
    if "://" in s or "." in s:
        s = _URL.sub("", s)
    if "@" in s:
        s = _EMAIL.sub("", s)
    if "*" in s:
        s = _EMPHASIS.sub(r"\1", s)
    return _BLANKS.sub(" ", s).strip(SPACE)


def typed(s: str, coded: bool) -> tuple[str, str]:
    """Kind and text of a line that is no fence, as in ``segment.lines``."""
    if coded or not s:
        return "b", ""
    if not _MARKED.search(s):
        return "p", s.strip(SPACE)
    if _HEADING.search(s) or _RULE.search(s):
        return "b", ""
    item = _ITEM.search(s)
    if item:
        text = _CHECKBOX.sub("", item[1]).strip(SPACE)
        return ("li", inline_clean(text)) if text else ("b", "")
    if "|" in s:
        cells = (c.strip(SPACE) for c in _BARS.sub("", s.strip(SPACE)).split("|"))
        table = inline_clean("，".join(c for c in cells if c))
        return ("b", "") if not table or _TABLE_RULE.search(s) else ("tr", table)
    return "p", inline_clean(s)


def units(text: str | None, config: Config) -> list[tuple[int, str, list[tuple[int, str]]]]:
    """(para, kind, [(unit, text)]) of a document, as in ``segment.units``."""
    if not config.markdown:
        parts = ((i, s.strip(SPACE)) for i, s in enumerate((text or "").split("\n")))
        return [(i, "para", [(0, s)]) for i, s in parts if s]
    out, before, coded = [], "b", False
    text = text or ""
    plain = not any(x in text for x in _INLINE) and "~~~" not in text
    for n, raw in enumerate(text.splitlines()):  # at LINE_BREAK, but for an empty last line
        s = raw.strip()  # of SPACE
        if not s:
            before = "b"
            continue
        if plain and s[0] != ">" and s[0] not in _STARTS and not s[0].isdecimal():
            kind = "p"
        else:
            if s[0] == ">":
                s = _QUOTED.sub("", s)
            if ("```" in s or "~~~" in s) and _FENCE.search(s):
                kind, coded = "b", not coded
            else:
                kind, s = typed(s, coded)
        if kind != "b":
            if kind != before:
                out.append((len(out), {"li": "list", "tr": "table"}.get(kind, "para"), []))
            own = out[-1][2]
            if kind == "p" and own:
                own[0] = (0, own[0][1] + "\n" + s)
            else:
                own.append((0 if kind == "p" else n, s))
        before = kind
    return out


@cache
def splitter(config: Config) -> Callable[[str], list[str]]:
    """The sentences of a unit, as in ``segment.split_sentences``."""
    away = "".join(chr(g.HIDDEN + i) for i in range(len(config.ends)))
    hide, show = str.maketrans(config.ends, away), str.maketrans(away, config.ends)
    special, strange = re.compile(f'[{g.OPEN_QUOTES}{g.CLOSE_QUOTES}"{away}]'), re.compile(f"[{away[0]}-{away[-1]}]")
    e, a = config.ends.replace("]", r"\]"), g.ABSORBED + config.ends
    whole = re.compile(f"[^{e}]++(?:[{e}][{a}]*+)?+|[{e}][{a}]*+")

    def hidden(text: str) -> str:
        depth, out = 0, []
        for i, run in enumerate(_QUOTE.split(text)):
            if i % 2 == 0:
                out.append(run.translate(hide) if depth else run)
                continue
            out.append(run)
            if run == '"':
                depth = 0 if depth else 1
            else:
                depth = depth + 1 if run in g.OPEN_QUOTES else max(depth - 1, 0)
        return "".join(out)

    def split(text: str) -> list[str]:
        if special.search(text):
            cut = [x.translate(show) if strange.search(x) else x for x in whole.findall(hidden(text))]
        else:
            cut = whole.findall(text)
        return list(filter(None, map(str.strip, cut)))  # of SPACE

    return split


class Judge:
    """What a sentence yields, whichever document it stands in: (clean, its length, CJK characters, more), where more is (hits, words, clause lengths, head), or null if there is none of them. Rules hit what has content, with ``contentless`` any text."""

    def __init__(self, pack: Pack | None, lexicon: list[str], flags: bool, contentless: bool = False) -> None:
        self.words, self.flags, self.contentless, self.known = lexicon, flags, contentless, {}
        rules = [(i, r.patterns) for i, r in enumerate(pack.rules) if r.scope == "sentence" and r.patterns] if pack else []
        self.rules = []
        for i, patterns in rules:
            ours = [translated(p) for p in patterns]
            fast = [p for p in ours if "(?" not in p]  # the others are for Python's engine alone
            slow = [p for p in ours if "(?" in p]
            self.rules.append((i, [re.compile(p, re.ASCII) for p in ours], "|".join(fast), re.compile("|".join(slow), re.ASCII) if slow else None, re.compile("|".join(f"(?:{p})" for p in ours), re.ASCII)))

    def _hits(self, texts: list[str]) -> list[list]:
        out = [[] for _ in texts]
        worth = [i for i, t in enumerate(texts) if self.contentless or _CONTENT.search(t)]
        column = pa.array([texts[i] for i in worth], pa.string()) if len(worth) >= FEW else None
        for i, patterns, fast, slow, whole in self.rules:
            if column is None:
                at = [k for k in worth if whole.search(texts[k])]
            else:
                found = set()
                if fast:
                    try:
                        found.update(pc.indices_nonzero(pc.match_substring_regex(column, fast)).to_pylist())
                    except pa.ArrowInvalid:  # a pattern that this engine has not
                        found.update(k for k, t in enumerate(worth) if whole.search(texts[t]))
                if slow:
                    found.update(k for k, t in enumerate(worth) if slow.search(texts[t]))
                at = [worth[k] for k in sorted(found)]
            for k in at:
                m = [x[0] for x in (p.search(texts[k]) for p in patterns) if x]
                if m:
                    out[k].append((i, m))
        return out

    def learn(self, texts: Iterable[str]) -> None:
        new = [t for t in texts if t not in self.known]
        for t, hits in zip(new, self._hits(new) if self.rules else [()] * len(new)):
            lens = ()
            if self.flags and _COMMAS.search(t):
                lens = tuple(n for n in map(len, _COMMAS.split(t.translate(_CLAUSES))) if n)
                lens = lens if len(lens) == 2 and all(d.CLAUSE[0] <= n <= d.CLAUSE[1] for n in lens) else ()
            clean, more = t.translate(_BARE), (hits, sum(t.count(w) for w in self.words), lens, t.startswith(_HEADS))
            self.known[t] = (clean, len(clean), sum(map(len, _CJK.findall(clean))), more if any(more) else None)


def shape(clean: str, n: int, balanced: int, sentences: int, lengths: int) -> list[str]:
    """As in ``domain.shape``."""
    if n < d.LEAST_CHARS:
        return []
    rate = lambda chars: sum(map(clean.count, chars)) / n
    out = ["classical"] if rate(d.PARTICLES) < d.DE_MAX and rate(d.STRONG) >= d.STRONG_MIN and rate(d.LE) < d.LE_MAX else []
    return out + ["verse"] * (balanced >= d.VERSE_SENTENCES and balanced / sentences >= d.VERSE_SHARE and lengths == 1)


def fact(cut: list, known: dict, shapes: list[int], most: int, flags: bool, need: list[str]) -> dict | None:
    """The row of a document of which ``cut`` holds (para, kind, [(unit, pos, text)]), without the sums over windows."""
    if not cut:
        return None
    texts = [s[2] for _, _, sents in cut for s in sents]
    cleans, sizes, cjk, more = zip(*[known[s] for s in texts]) if texts else ((),) * 4
    upto = [0, *accumulate(sizes)]
    psq = conn = b = at = 0
    found, shaped, paras, kinds, head, lens = [], [], [], [], False, {}
    for para, kind, sents in cut:
        start, at = at, at + len(sents)
        length, own_b, own_lens = upto[at] - upto[start], 0, {}
        psq += length * length
        for (unit, pos, text), own in zip(sents, more[start:at]):
            if own:
                hits, words, clauses, is_head = own
                conn += words
                for i, m in hits:
                    found.append((para, unit, pos, text, i, m))
                if clauses:
                    own_b += 1
                    own_lens.update(dict.fromkeys(clauses))
                if is_head:
                    head = True
        if flags:
            b += own_b
            lens |= own_lens
            if length >= d.LEAST_CHARS:
                kinds += shape("".join(cleans[start:at]), length, own_b, len(sents), len(own_lens))
        if shapes and kind == "para" and len(sents) == 1 and len(sents[0][2]) <= most and _CONTENT.search(sents[0][2]):
            shaped.append((para, *sents[0]))
        if "p" in need:
            paras.append((para, kind, len(sents), sents[0][2] if sents else None))
    for i in shapes:
        found += [(q, u, x, t, i, [t]) for q, u, x, t in shaped]
    n_s, n_c, sq, raw, clean = len(texts), upto[-1], sum(map(mul, sizes, sizes)), "".join(texts), "".join(cleans)
    double = raw.count("——")
    row = {"n_paragraphs": len(cut), "n_sentences": n_s, "n_chars": n_c, "sum_sq": sq, "para_sq": psq, "conn": conn, "dashes": raw.count("—") - double, "raw": raw, "clean": clean, "found": found, "p": paras}
    if flags:
        row |= {"head": head, "shapes": shape(clean, n_c, b, n_s, len(lens)) + kinds, "cjk": sum(cjk)}
    return row


def found_of(cut: list, known: dict, shapes: list[int], most: int) -> dict | None:
    """``fact`` where only the hits are wanted."""
    if not cut:
        return None
    found = [(para, unit, pos, text, i, m) for para, _, sents in cut for unit, pos, text in sents if (more := known[text][3]) for i, m in more[0]]
    if shapes:
        first = [(para, *sents[0]) for para, kind, sents in cut if kind == "para" and len(sents) == 1 and len(sents[0][2]) <= most and _CONTENT.search(sents[0][2])]
        found += [(q, u, x, t, i, [t]) for i in shapes for q, u, x, t in first]
    return {"found": found}


SUMS = ("tokens", "window_sum", "grams", "distinct_grams")
COUNTS = ("n_paragraphs", "n_sentences", "n_chars", "sum_sq", "para_sq", "conn", "dashes")
FLAGS = ("head", "shapes", "cjk")
_STRUCTS = {
    "found": {"para": pa.int32(), "unit": pa.int32(), "pos": pa.int32(), "sentence": pa.string(), "rule_ord": pa.int32(), "matches": pa.list_(pa.string())},
    "p": {"para": pa.int32(), "kind": pa.string(), "n": pa.int64(), "head": pa.string()},
}
_PLAIN = dict.fromkeys((*COUNTS, *SUMS, "cjk"), pa.int64()) | {"raw": pa.string(), "clean": pa.string(), "head": pa.bool_(), "shapes": pa.list_(pa.string())}
_SQL = dict.fromkeys((*COUNTS, *SUMS, "cjk"), "long") | {
    "raw": "string", "clean": "string", "head": "boolean", "shapes": "array<string>",
    "found": "array<struct<para: int, unit: int, pos: int, sentence: string, rule_ord: int, matches: array<string>>>",
    "p": "array<struct<para: int, kind: string, n: bigint, head: string>>",
}


def _column(rows: list[dict | None], name: str) -> pa.Array:
    """A field of all rows; lists of structs are made field by field, which costs a fraction of a dict each."""
    if name in _PLAIN:
        return pa.array([r and r[name] for r in rows], _PLAIN[name])
    lists = [r[name] if r else () for r in rows]
    parts = list(zip(*(x for own in lists for x in own))) or [()] * len(_STRUCTS[name])
    items = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(parts, _STRUCTS[name].values())], names=list(_STRUCTS[name]))
    return pa.ListArray.from_arrays(pa.array(accumulate(map(len, lists), initial=0), pa.int32()), items)


def supports(pack: Pack | None, lexicon: list[str]) -> bool:
    return all(lexicon) and all(translated(p) is not None for r in (pack.rules if pack else ()) if r.scope == "sentence" for p in r.patterns)


def extractor(pack: Pack | None, lexicon: list[str], config: Config, flags: bool, most: int, columns: list[str]):
    """A column function: the texts of a document, as an array, to the struct of its facts, null where it has no block."""
    shapes = [i for i, r in enumerate(pack.rules) if r.scope == "shape"] if pack else []
    state: dict = {}

    def cut_of(texts: list[str | None], split: Callable[[str], list[str]]) -> list:
        cut = [[(q, k, [x for u, t in own for x in zip(repeat(u), count(), split(t))]) for q, k, own in units(text, config)] for text in texts]
        if len(cut) == 1:
            return cut[0]
        both: dict = {}
        for q, k, s in (x for c in cut for x in c):
            both.setdefault((q, k), []).extend(s)
        return [(q, k, sorted(s)) for (q, k), s in sorted(both.items())]

    def run(column: pa.Array) -> pa.Array:
        if not state:
            state.update(judge=Judge(pack, lexicon, flags), split=splitter(config))
        judge, parts = state["judge"], []
        for at in range(0, max(len(column), 1), SLICE):
            docs = column.slice(at, SLICE).to_pylist()
            cuts = [cut_of(texts, state["split"]) for texts in docs]
            if len(judge.known) > REMEMBERED:
                judge.known = {}
            judge.learn(dict.fromkeys(map(itemgetter(2), chain.from_iterable(sents for cut in cuts for _, _, sents in cut))))
            if columns == ["found"]:
                rows = [found_of(cut, judge.known, shapes, most) for cut in cuts]
            else:
                rows = [fact(cut, judge.known, shapes, most, flags, columns) for cut in cuts]
            if "tokens" in columns:
                some = [r for r in rows if r]
                for r, sums in zip(some, sums_of([r["clean"] for r in some])):
                    r |= zip(SUMS, sums)
            parts.append(pa.StructArray.from_arrays([_column(rows, c) for c in columns], names=columns, mask=pa.array([r is None for r in rows], pa.bool_())))
        return pa.concat_arrays(parts)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    # not computed anew for a filter on what it yields
    return F.arrow_udf(run, f"struct<{', '.join(f'{c}: {_SQL[c]}' for c in columns)}>").asNondeterministic()


def matcher(pack: Pack):
    """A column function: a text to the ids of the sentence rules that hit it, in order, none for null."""
    ids = [r.id for r in pack.rules]
    state: dict = {}

    def run(column: pa.Array) -> pa.Array:
        if not state:
            state.update(judge=Judge(pack, [], False, contentless=True))
        judge = state["judge"]
        if len(judge.known) > REMEMBERED:
            judge.known = {}
        texts = column.to_pylist()
        judge.learn(dict.fromkeys(t for t in texts if t is not None))
        return pa.array([[ids[i] for i, _ in more[0]] if t is not None and (more := judge.known[t][3]) else [] for t in texts], pa.list_(pa.string()))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>").asNondeterministic()
