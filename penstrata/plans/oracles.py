"""SQL of the same results for DuckDB, put together from named parts."""

from __future__ import annotations

from penstrata.functions.text import BARE, PUNCTUATION, WS
from penstrata.operators import domain, rewrite, segment
from penstrata.packs import Pack
from penstrata.sources.synthetic import BANK, EVERY, MARKDOWN, SPECIAL


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(xs: list[str]) -> str:
    return "[" + ", ".join(map(lit, xs)) + "]"


_CJK = r"[\x{4e00}-\x{9fa5}]"
#: The one pattern with a lookahead: the third item of eight characters may not stand before 等, a shorter one ends where it must.
_TRIAD = r"[\u4e00-\u9fa5]{2,8}[、][\u4e00-\u9fa5]{2,8}[、][\u4e00-\u9fa5]{2,8}(?!等)"
_TRIAD_RE2 = f"({_CJK}{{2,8}}、{_CJK}{{2,8}}、{_CJK}{{8}})(?:[^等]|$)|({_CJK}{{2,8}}、{_CJK}{{2,8}}、{_CJK}{{2,7}})(?:[^等]|$)"


def re2(pattern: str) -> str:
    """A pattern of a pack in RE2's dialect."""
    return _TRIAD_RE2 if pattern == _TRIAD else pattern


def first_match(text: str, pattern: str) -> str:
    """The first match of a pattern of a pack, or null."""
    p = lit(re2(pattern))
    found = f"coalesce(nullif(regexp_extract({text}, {p}, 1), ''), regexp_extract({text}, {p}, 2))" if pattern == _TRIAD else f"regexp_extract({text}, {p})"
    return f"CASE WHEN regexp_matches({text}, {p}) THEN {found} END"


def zh(name: str = "zh", step: int = 7, between: str = "") -> str:
    """The synthetic documents, their paragraphs and sentences: ``{name}_doc``, ``{name}_para``, ``{name}_sent``."""
    return f"""
{name}_item AS (
    SELECT o_custkey AS doc_id, l_orderkey AS ok, l_linenumber AS ln,
        replace(({arr(BANK)})[CAST((l_orderkey * {step} + l_linenumber * 13 + l_partkey * 5 + l_suppkey) % {len(BANK)} + 1 AS INTEGER)],
            '{{q}}', CAST(CAST(floor(l_quantity) AS INTEGER) AS VARCHAR)) AS s
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), {name}_doc AS (
    SELECT doc_id, CASE WHEN doc_id % {EVERY} < {len(SPECIAL)} THEN ({arr(SPECIAL)})[CAST(doc_id % {EVERY} + 1 AS INTEGER)] ELSE string_agg(p, chr(10) || chr(10) ORDER BY ok) END AS text
    FROM (SELECT doc_id, ok, string_agg(s, {lit(between)} ORDER BY ln, s) AS p FROM {name}_item GROUP BY doc_id, ok) GROUP BY doc_id
), {segments(name)}"""


def segments(name: str) -> str:
    """``{name}_para`` and ``{name}_sent`` of ``{name}_doc``."""
    return f"""{name}_para AS (
    SELECT doc_id, CAST(unnest(range(len(ps))) AS INTEGER) AS para, unnest(ps) AS p
    FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM {name}_doc)
), {name}_sent AS ({cut_sentences(f"SELECT doc_id, para, p FROM {name}_para", segment.ENDS)})"""


def hidden(p: str, ends: str, away: str) -> str:
    """``p`` with the terminators inside quotes replaced: a fold over runs, whose state begins with the depth as a character."""
    o, c = segment.OPEN_QUOTES, segment.CLOSE_QUOTES
    listed = lambda q: ", ".join(lit(x) for x in q)
    return f"""substr(list_reduce(list_prepend('0', regexp_extract_all({p}, {lit(f'[{o}{c}"]|[^{o}{c}"]+')})), lambda a, x: CASE
        WHEN x IN ({listed(o)}) THEN chr(ascii(a) + 1) || substr(a, 2) || x
        WHEN x IN ({listed(c)}) THEN chr(greatest(48, ascii(a) - 1)) || substr(a, 2) || x
        WHEN x = '"' THEN CASE WHEN ascii(a) > 48 THEN '0' ELSE '1' END || substr(a, 2) || x
        WHEN ascii(a) > 48 THEN a || translate(x, {lit(ends)}, {lit(away)}) ELSE a || x END), 2)"""


def cut_sentences(source: str, ends: str) -> str:
    """(doc_id, para, pos, text, clean, n) from (doc_id, para, p)."""
    e, a = ends, segment.ABSORBED + ends
    away = "".join(chr(segment.HIDDEN + i) for i in range(len(ends)))
    return f"""
    SELECT doc_id, para, pos, text, regexp_replace(text, {lit(BARE)}, '', 'g') AS clean, CAST(length(regexp_replace(text, {lit(BARE)}, '', 'g')) AS BIGINT) AS n
    FROM (SELECT doc_id, para, CAST(unnest(range(len(ss))) AS INTEGER) AS pos, translate(unnest(ss), {lit(away)}, {lit(e)}) AS text FROM (
        SELECT doc_id, para, list_filter(list_transform(regexp_extract_all({hidden("p", e, away)}, {lit(f'[^{e}]*[{e}][{a}]*|[^{e}]+')}),
            lambda x: regexp_replace(x, {lit(f'^{WS}+|{WS}+$')}, '', 'g')), lambda x: x <> '') AS ss
        FROM ({source})))"""


def cv(n: str, s: str, q: str) -> str:
    n, s, q = (f"CAST({x} AS DOUBLE)" for x in (n, s, q))
    return f"CASE WHEN {n} >= 3 AND {s} > 0 THEN sqrt(greatest(0.0, ({q} - {s} * {s} / {n}) / ({n} - 1))) / ({s} / {n}) END"


def scaled(x: str) -> str:
    return f"CAST(floor(({x}) * 10000 + 0.5) AS BIGINT)"


def count_of(text: str, word: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, {lit(word)}, ''))) / {len(word)} AS BIGINT)"


def stats(lexicon: list[str], name: str = "zh") -> str:
    """``counts`` and ``stats`` of the synthetic documents."""
    words = " + ".join(count_of("text", w) for w in lexicon) or "0"
    conn = "conn / CAST(n_sentences AS DOUBLE)" if lexicon else "CAST(NULL AS DOUBLE)"
    return f"""
by_para AS (
    SELECT doc_id, para, count(*) AS n, sum(n) AS len, sum(n * n) AS sq, sum({words}) AS conn,
        string_agg(text, '' ORDER BY pos) AS raw, string_agg(clean, '' ORDER BY pos) AS clean
    FROM {name}_sent GROUP BY doc_id, para
), counts AS (
    SELECT doc_id, count(*) AS n_paragraphs, sum(n) AS n_sentences, sum(len) AS n_chars, sum(sq) AS sum_sq, sum(len * len) AS para_sq, sum(conn) AS conn,
        string_agg(raw, '' ORDER BY para) AS raw, string_agg(clean, '' ORDER BY para) AS clean
    FROM by_para GROUP BY doc_id
), token AS (
    SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id, t ORDER BY p) AS q, m, least(m, 100) AS w FROM (
        SELECT doc_id, unnest(range(length(clean) - 1)) AS p, substr(clean, CAST(unnest(range(length(clean) - 1)) + 1 AS BIGINT), 2) AS t, length(clean) - 1 AS m FROM counts)
), mattr AS (
    SELECT doc_id, sum(greatest(0, least(p, m - w) - greatest(coalesce(q, -1) + 1, greatest(p - w + 1, 0)) + 1)) AS window_sum, any_value(m) AS tokens, any_value(w) AS w
    FROM token GROUP BY doc_id
), gram AS (
    SELECT doc_id, len(g) AS grams, len(list_distinct(g)) AS distinct_grams
    FROM (SELECT doc_id, list_transform(range(1, length(clean) - 2), lambda i: substr(clean, i, 4)) AS g FROM counts)
), stats AS (
    SELECT doc_id, n_paragraphs, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(n_chars AS BIGINT) AS n_chars,
        {cv("n_sentences", "n_chars", "sum_sq")} AS sentence_cv, {cv("n_paragraphs", "n_chars", "para_sq")} AS para_len_cv,
        CAST(window_sum AS DOUBLE) / (CAST(w AS DOUBLE) * (tokens - w + 1)) AS ttr, {conn} AS conn_density,
        CASE WHEN n_chars < 8 THEN 0.0 ELSE 1 - CAST(distinct_grams AS DOUBLE) / grams END AS ngram_repeat,
        CAST({count_of("raw", "——")} + {count_of("raw", "—")} - 2 * {count_of("raw", "——")} AS DOUBLE) / n_sentences AS dash_density, CAST(n_chars AS DOUBLE) / n_sentences AS avg_sentence_len
    FROM counts LEFT JOIN mattr USING (doc_id) JOIN gram USING (doc_id)
)"""


def hits(pack: Pack, name: str = "zh", out: str = "hit") -> str:
    """``hit`` (ungated) and ``gate`` of a pack over the synthetic sentences."""
    found = []
    for i, r in enumerate(pack.rules):
        if r.scope == "sentence":
            one = ", ".join(first_match("text", p) for p in r.patterns)
            found.append(f"{{'rule_ord': {i}, 'rule_id': {lit(r.id)}, 'severity': {lit(r.severity)}, 'weight': CAST({r.weight} AS DOUBLE), 'matches': list_filter([{one}], lambda x: x IS NOT NULL)}}")
    shape = ""
    for i, r in enumerate(pack.rules):
        if r.scope == "shape":
            shape += f"""
    UNION ALL SELECT doc_id, para, any_value(pos), any_value(text), {{'rule_ord': {i}, 'rule_id': {lit(r.id)}, 'severity': {lit(r.severity)}, 'weight': CAST({r.weight} AS DOUBLE), 'matches': [any_value(text)]}}
        FROM {name}_sent GROUP BY doc_id, para HAVING count(*) = 1 AND any_value(length(text)) <= 40 AND any_value(regexp_matches(text, '[0-9A-Za-z\\x{{4e00}}-\\x{{9fff}}]'))"""
    return f"""
{out}_raw AS (
    SELECT * FROM (SELECT doc_id, para, pos, text AS sentence, unnest([{', '.join(found)}]) AS h FROM {name}_sent WHERE regexp_matches(text, '[0-9A-Za-z\\x{{4e00}}-\\x{{9fff}}]')) WHERE len(h.matches) > 0{shape}
), {out} AS (
    SELECT doc_id, para, pos, sentence, h.rule_ord AS rule_ord, h.rule_id AS rule_id, h.severity AS severity, h.weight AS weight, h.matches AS matches,
        h.severity = 'low' AND count(*) OVER (PARTITION BY doc_id, h.rule_id) = 1 AS is_hint
    FROM {out}_raw
)"""


def threshold(rule) -> str:
    out = str(rule.threshold)
    for limit, value in reversed(rule.tiers):
        out = str(value) if limit is None else f"CASE WHEN n_chars < {limit} THEN {value} ELSE {out} END"
    return out


def doc_rules(pack: Pack) -> str:
    """``whole``: document rules that hold."""
    parts = [f"SELECT doc_id, {i} AS rule_ord, '{r.id}' AS rule_id, '{r.metric}' AS metric, {r.metric} AS value FROM stats WHERE n_sentences >= {r.min_sentences} AND {r.metric} {'>' if r.compare == 'above' else '<'} {threshold(r)}" for i, r in enumerate(pack.rules) if r.scope == "doc"]
    return "whole AS (" + " UNION ALL ".join(parts) + ")"


def score(pack: Pack) -> str:
    """``score``: parts, note and index; ``flag`` must be there, as must ``stats`` and ``hit``."""
    s = pack.scoring

    def coef(f: str) -> str:
        out = str(s.get(f, "NULL"))
        for t in s.get("tiers", []):
            out = f"CASE WHEN n_chars >= {t['min_chars']} THEN {t.get(f, 'NULL')} ELSE {out} END"
        for kind, model in s.get("genres", {}).items():
            out = out if model.get("suppress") else f"CASE WHEN genre = {lit(kind)} THEN {model.get(f, 'NULL')} ELSE {out} END"
        return f"CAST({out} AS DOUBLE)"

    features = ("hit_density", "sentence_cv", "ttr", "ngram_repeat", "conn_density")
    if not s:
        parts = "".join(f", CAST(NULL AS DOUBLE) AS c_{f}" for f in features)
        return f"score AS (SELECT doc_id, n_sentences, n_chars{parts}, CAST(NULL AS DOUBLE) AS index, CASE WHEN NOT has_content THEN 'no valid text' WHEN non_chinese THEN 'not Chinese' WHEN n_sentences >= 8 THEN 'profile not calibrated' END AS note FROM stats JOIN flag USING (doc_id))"
    z = " + ".join([coef("intercept"), *(f"coalesce(c_{f}, 0.0)" for f in features)])
    suppressed = " OR ".join(f"genre = {lit(k)}" for k, v in s.get("genres", {}).items() if v.get("suppress")) or "false"
    genre = f"list_filter(kinds, lambda x: list_contains({arr(list(s['genres']))}, x))[1]" if s.get("genres") else "CAST(NULL AS VARCHAR)"
    return f"""
weights AS (SELECT doc_id, sum(weight) AS weight FROM hit GROUP BY doc_id),
genred AS (SELECT *, {genre} AS genre FROM flag),
feature AS (
    SELECT stats.*, coalesce(weight, 0.0) / n_sentences AS hit_density, CASE WHEN NOT has_content THEN 'no valid text' WHEN non_chinese THEN 'not Chinese' WHEN {suppressed} THEN 'genre not calibrated' END AS note, genre
    FROM stats JOIN genred USING (doc_id) LEFT JOIN weights USING (doc_id)
),
part AS (SELECT doc_id, n_sentences, n_chars, note, genre, {', '.join(f'CASE WHEN n_sentences >= 8 AND note IS NULL THEN {coef(f)} * {f} END AS c_{f}' for f in features)} FROM feature),
score AS (SELECT *, CASE WHEN n_sentences >= 8 AND note IS NULL THEN 100.0 / (1.0 + exp(-greatest(-30.0, least(30.0, {z})))) END AS index FROM part)"""


def flags(genre: bool = False, officialese: bool = True) -> str:
    """``flag``: kinds of the synthetic documents in order, each once."""
    def shape(clean: str, bal: str, n: str, lens: str) -> str:
        rate = lambda chars: f"(length({clean}) - length(translate({clean}, {lit(chars)}, ''))) / CAST(length({clean}) AS DOUBLE)"
        return f"""CASE WHEN length({clean}) >= 80 THEN list_filter([
            CASE WHEN {rate(domain.PARTICLES)} < {domain.DE_MAX} AND {rate(domain.STRONG)} >= {domain.STRONG_MIN} AND {rate(domain.LE)} < {domain.LE_MAX} THEN 'classical' END,
            CASE WHEN {bal} >= 4 AND {bal} / CAST({n} AS DOUBLE) >= 0.6 AND len(list_distinct({lens})) = 1 THEN 'verse' END], lambda x: x IS NOT NULL) ELSE CAST([] AS VARCHAR[]) END"""

    when = lambda c, kind: f"CASE WHEN length(clean) >= 80 AND ({c}) THEN ['{kind}'] ELSE CAST([] AS VARCHAR[]) END"
    parts = [shape("clean", "b", "n", "lens"), "inner_kinds"]
    parts += [when(f"contains(raw, {lit(phrase)})", k) for k, phrase in domain.GENRES.items()] if genre else []
    parts += [when(f"regexp_matches(raw, {lit('|'.join(domain.OFFICIAL))}) OR head", "officialese")] if officialese else []
    foreign = "length(clean) >= 80 AND length(regexp_replace(clean, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) / CAST(length(clean) AS DOUBLE) < 0.3"
    parts.append(when(foreign, "non-chinese"))
    return f"""
clause AS (
    SELECT *, len(c) = 2 AND len(list_filter(c, lambda x: x BETWEEN 5 AND 9)) = 2 AS even FROM (
        SELECT doc_id, para, pos, text, clean, list_filter(list_transform(string_split_regex(text, '[，、；]'), lambda x: length(regexp_replace(x, {lit(BARE)}, '', 'g'))), lambda x: x > 0) AS c FROM zh_sent)
), flag_para AS (
    SELECT doc_id, para, count(*) AS n, count(*) FILTER (even) AS b, flatten(list(CASE WHEN even THEN c ELSE [] END)) AS lens, string_agg(clean, '' ORDER BY pos) AS clean, string_agg(text, '' ORDER BY pos) AS raw,
        bool_or(starts_with(text, '抄送') OR starts_with(text, '主送')) AS head
    FROM clause GROUP BY doc_id, para
), flag_shape AS (SELECT *, {shape("clean", "b", "n", "lens")} AS kinds FROM flag_para),
flag_doc AS (
    SELECT doc_id, sum(n) AS n, sum(b) AS b, flatten(list(lens)) AS lens, string_agg(clean, '' ORDER BY para) AS clean, string_agg(raw, '' ORDER BY para) AS raw, bool_or(head) AS head, flatten(list(kinds ORDER BY para)) AS inner_kinds
    FROM flag_shape GROUP BY doc_id
), flag_list AS (
    SELECT doc_id, clean, raw, flatten([{", ".join(parts)}]) AS all_kinds FROM flag_doc
), flag AS (
    SELECT doc_id, list_filter(all_kinds, lambda x, i: list_position(all_kinds, x) = i) AS kinds, {foreign} AS non_chinese, regexp_matches(raw, '[0-9A-Za-z\\x{{4e00}}-\\x{{9fff}}]') AS has_content FROM flag_list
)"""


STRIP = lambda x: f"regexp_replace({x}, {lit(f'^{WS}+|{WS}+$')}, '', 'g')"


def advice(source: str, pack: Pack, keys: str, out: str = "advice") -> str:
    """``{out}``: keys, text, action, rules, taste, candidate and direction of (keys, text) of ``source``."""
    rules = pack.of_scope("sentence")
    hit = {r.id: "(" + " OR ".join(f"regexp_matches(text, {lit(p)})" for p in r.patterns) + ")" for r in rules}
    ids = ", ".join(f"CASE WHEN {hit[r.id]} THEN {lit(r.id)} END" for r in rules)
    taste = "MAP {" + ", ".join(f"{lit(r.id)}: {lit(r.taste)}" for r in rules) + "}"
    bare_paren = lambda x: STRIP(f"regexp_replace({x}, {lit(rf'[（(][^）)]*[）)]{WS}*$')}, '')")
    has = lambda i: f"list_contains(rules, '{i}')"
    m = lambda x, p: f"regexp_matches({x}, {lit(p)})"
    manual = "len(list_filter(rules, lambda x: starts_with(x, 'T-MANUAL'))) > 0"
    you = rewrite.YOU_WHO
    plan = [
        (manual, None, "delete: instructions are not kept"),
        (has("T-VOICE-05"), None, "delete: say it in one sentence without reasons"),
        (f"{has('T-VOICE-01')} AND {m('body', rewrite.COMFORT)}", None, "delete: comfort without a fact"),
        (f"{has('T-VOICE-01')} AND two AND NOT {m('heads[1]', rewrite.EMPTY_HEAD)} AND NOT several", "heads[1] || '。'", ""),
        (f"{has('T-VOICE-01')} AND two AND NOT {m('heads[1]', rewrite.EMPTY_HEAD)}", None, "drop the comforting half after the comma"),
        (f"{has('T-VOICE-01')} AND two", None, "delete: the first half says nothing"),
        (f"{has('T-VOICE-02')} AND two AND NOT several", "heads[1] || '。'", ""),
        (f"{has('T-VOICE-02')} AND two", None, "drop the uplifting half, keep the action"),
        (f"{has('T-VOICE-07')} AND you <> '' AND NOT {m('you', rewrite.SEVERAL)}", f"{STRIP('you')} || '。'", ""),
        (f"{has('T-VOICE-11')} AND {STRIP('bare_of')} <> ''", "bare_of || '。'", ""),
        (has("T-VOICE-11"), None, "delete: nothing but summing up"),
        (f"{has('T-VOICE-10')} OR {has('T-VOICE-12')} OR {has('T-VOICE-04')}", None, "delete: slogans inform nobody"),
        (f"{m('body', rewrite.NOUN)} OR {m('body', rewrite.MEME)}", None, "cut the mannered half, keep the fact"),
        ("true", None, "cut the mannered half, keep the fact; add a concrete noun"),
    ]
    cases = " ".join(f"WHEN {c} THEN {{'candidate': {x or 'CAST(NULL AS VARCHAR)'}, 'direction': {lit(d)}}}" for c, x, d in plan)
    flat = lambda x: f"regexp_replace({x}, {lit('[。！？～' + WS[1:-1] + ']')}, '', 'g')"
    keep = "(important OR len(rules) = 0)"
    return f"""
{out}_rules AS (
    SELECT *, list_filter([{ids}], lambda x: x IS NOT NULL) AS rules, {m('text', rewrite.IMPORTANT)} AS important, {bare_paren("regexp_replace(text, '[。！？～]+$', '')")} AS body FROM {source}
), {out}_parts AS (
    SELECT *, list_filter(list_transform(string_split_regex(body, '[，,]'), lambda x: {STRIP('x')}), lambda x: x <> '') AS heads, {m('body', rewrite.SEVERAL)} AS several,
        regexp_extract(body, {lit(you)}, 1) AS you, regexp_replace(body, {lit(rewrite.SUMMING + WS + '*')}, '', 'g') AS bare_of
    FROM {out}_rules
), {out}_plan AS (
    SELECT *, CASE {cases} END AS p FROM (SELECT *, len(heads) >= 2 AS two FROM {out}_parts)
), {out}_told AS (
    SELECT *, CASE WHEN same THEN NULL ELSE p.candidate END AS cand, CASE WHEN same AND p.direction = '' THEN 'cut the mannered half, keep the fact' ELSE p.direction END AS dir
    FROM (SELECT *, p.candidate IS NOT NULL AND {flat('p.candidate')} = {flat('text')} AS same FROM {out}_plan)
), {out} AS (
    SELECT {keys}, text, rules, list_filter(list_transform(rules, lambda x: {taste}[x]), lambda x: x <> '') AS taste,
        CASE WHEN {keep} THEN 'keep' WHEN {manual} OR (cand IS NULL AND starts_with(dir, 'delete')) THEN 'delete' WHEN cand IS NOT NULL OR length({bare_paren('text')}) > {rewrite.SUBSTANCE} THEN 'rewrite' ELSE 'delete' END AS action,
        CASE WHEN NOT {keep} THEN cand END AS candidate,
        CASE WHEN important THEN '' WHEN len(rules) = 0 THEN CASE WHEN {m('text', rewrite.NOUN)} OR {m('text', rewrite.MEME)} THEN '' ELSE 'if this is copy, add a concrete noun' END ELSE dir END AS direction
    FROM {out}_told
)"""


def text_lines(name: str) -> str:
    """``{name}_raw`` and ``{name}_line`` of ``{name}_doc``: lines from 1 on, those with text apart."""
    return f"""
{name}_raw AS (
    SELECT doc_id, CAST(unnest(range(1, len(x) + 1)) AS INTEGER) AS line, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM {name}_doc)
), {name}_line AS (
    SELECT * FROM (SELECT doc_id, line, raw, {STRIP(f"regexp_replace(raw, {lit(f'^{WS}*[-*+]{WS}+')}, '')")} AS text FROM {name}_raw) WHERE text <> ''
)"""


def collapsed(sizes: list[int]) -> str:
    """``kept`` of ``candidate(gram, df_1)``, one length after the other from the longest down."""
    parts, done = [], []
    for n in sorted(sizes, reverse=True):
        if done:
            longer = " UNION ALL ".join(f"SELECT * FROM kept_{x}" for x in done)
            parts.append(f"over_{n} AS (SELECT gram, max(df_1) AS over FROM (SELECT unnest(list_distinct(list_transform(range(1, length(gram) - {n} + 2), lambda i: substr(gram, i, {n})))) AS gram, df_1 FROM ({longer})) GROUP BY gram)")
            parts.append(f"kept_{n} AS (SELECT gram, df_1 FROM candidate LEFT JOIN over_{n} USING (gram) WHERE length(gram) = {n} AND (over IS NULL OR df_1 > 2 * over))")
        else:
            parts.append(f"kept_{n} AS (SELECT gram, df_1 FROM candidate WHERE length(gram) = {n})")
        done.append(n)
    return ",\n".join(parts) + ",\nkept AS (" + " UNION ALL ".join(f"SELECT * FROM kept_{x}" for x in done) + ")"


def md() -> str:
    """``md_line``, typed lines of the Markdown view."""
    w = WS
    strip = lambda x: f"regexp_replace({x}, {lit(f'^{w}+|{w}+$')}, '', 'g')"
    clean = "t"
    for p, to in (("`([^`]*)`", r"\1"), (r"!\[([^\]]{0,300})\]\(([^)]{0,500})\)", r"\1"), (r"\[([^\]]{0,300})\]\(([^)]{0,500})\)", r"\1"), (segment.URL, ""), (segment.EMAIL, ""), (r"\*{1,3}([^*\s][^*]{0,97}[^*\s])\*{1,3}", r"\1"), (r"[ \t]{2,}", " ")):
        clean = f"regexp_replace({clean}, {lit(p)}, {lit(to)}, 'g')"
    item = rf"^{w}*(?:[-*+]{w}+|\p{{Nd}}+[.、)]){w}*(.*)$"
    return f"""
md_doc AS (
    SELECT o_custkey AS doc_id, string_agg(replace(({arr(MARKDOWN)})[CAST((o_orderkey * 5 + o_custkey * 3) % {len(MARKDOWN)} + 1 AS INTEGER)], '{{k}}', CAST(o_orderkey AS VARCHAR)), chr(10) ORDER BY o_orderkey) AS text
    FROM orders GROUP BY o_custkey
), md_raw AS (
    SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS line, regexp_replace({strip("unnest(x)")}, {lit(f'^{w}*>+{w}?')}, '') AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM md_doc)
), md_fence AS (
    SELECT *, coalesce(sum(CASE WHEN regexp_matches(s, '^(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS coded FROM md_raw
), md_kind AS (
    SELECT doc_id, line, s, CASE
        WHEN coded OR s = '' OR regexp_matches(s, '^(```|~~~)') OR regexp_matches(s, '^#{{1,6}}(\\s|$)') OR regexp_matches(s, '^-{{2,}}$|^=+$') THEN 'b'
        WHEN regexp_matches(s, {lit(item)}) THEN 'li' WHEN contains(s, '|') THEN CASE WHEN regexp_matches(s, '^[|: -]+$') THEN 'b' ELSE 'tr' END ELSE 'p' END AS kind
    FROM md_fence
), md_text AS (
    SELECT doc_id, line, kind, CASE kind WHEN 'b' THEN '' WHEN 'li' THEN regexp_replace(regexp_extract(s, {lit(item)}, 1), '^\\[[ xX]\\]\\s*', '')
        WHEN 'tr' THEN array_to_string(list_filter(list_transform(string_split(trim(s, '|'), '|'), lambda x: trim(x)), lambda x: x <> ''), '，') ELSE s END AS t
    FROM md_kind
), md_line AS (SELECT doc_id, line, kind, {strip(clean)} AS text FROM md_text)"""


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select.strip()

