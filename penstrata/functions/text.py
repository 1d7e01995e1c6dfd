"""Column functions on text. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, listed since engines disagree on \s.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Punctuation that no length counts.
PUNCTUATION = "，。！？；：、…“”‘’《》（）()[]【】,.!?;:\"'—-"
#: Line breaks.
LINE_BREAK = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"
#: What makes a sentence worth matching.
CONTENT = "[0-9A-Za-z一-鿿]"
CJK_FIRST, CJK_LAST = "一", "鿿"


def char_class(chars: str) -> str:
    """A regex class of exactly these characters, for Java and RE2 alike."""
    return "[" + "".join("\\" + c if c in "\\]^-[" else c for c in chars) + "]"


WS = char_class(SPACE)
BARE = char_class(PUNCTUATION + SPACE)


def strip(c: Column) -> Column:
    """Without white space at either end; by the built-in trim, as a regex would test each character of the text against the whole class."""
    return F.btrim(c, F.lit(SPACE))


def bare(c: Column) -> Column:
    """Without punctuation and white space; by look-up, as a regex would try a chain of some fifty characters at each place."""
    return F.translate(c, PUNCTUATION + SPACE, "")


def count_of(c: Column, word: str) -> Column:
    """Occurrences of ``word`` that do not overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("long")


def chars_in(c: Column, chars: str) -> Column:
    """Characters of ``c`` that are among ``chars``."""
    return (F.length(c) - F.length(F.translate(c, chars, ""))).cast("long")


def grams(c: Column, sizes: list[int]) -> Column:
    """All runs of so many characters, in order for each size.

    The text is bound and split into characters once; taking substrings of an
    expression would evaluate it anew, and scan the text, at every place.
    """

    def runs(chars: Column, k: int) -> Column:
        at = F.sequence(F.lit(1), F.size(chars) - (k - 1))
        made = F.transform(at, lambda i: F.concat(*[F.element_at(chars, i + j) for j in range(k)]))
        return F.when(F.size(chars) >= k, made).otherwise(F.array().cast("array<string>"))

    def of(chars: Column) -> Column:
        return F.concat(*[runs(chars, k) for k in sizes])

    return F.flatten(F.transform(F.array(F.filter(F.split(c, ""), lambda x: x != "")), of))


def cv(n: Column, s: Column, q: Column) -> Column:
    """Sample standard deviation over mean, from the count, sum and sum of squares; null below three values or a mean of 0."""
    n, s, q = (x.cast("double") for x in (n, s, q))
    return F.when((n >= 3) & (s > 0), F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1))) / (s / n))


def scaled(c: Column) -> Column:
    """Four decimals as a whole number, the same in every engine."""
    return F.floor(c * 10000 + 0.5).cast("long")


def sha_prefix(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def mask_pii(c: Column) -> Column:
    """Identity numbers, mobile numbers, e-mail addresses and card numbers, masked in this order. Digits of every script count."""
    d = r"\p{Nd}"
    for pattern, mask in (
        (rf"(?<!{d}){d}{{17}}[{d}Xx](?!{d})", "【身份证号】"),
        (rf"(?<!{d})1[3-9]{d}{{9}}(?!{d})", "【手机号】"),
        (r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9._-]{1,63})+", "【邮箱】"),
        (rf"(?<!{d}){d}{{16,}}(?!{d})", "【卡号】"),
    ):
        c = F.regexp_replace(c, pattern, mask)
    return c


#: Entities by name, with what they stand for.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&mdash;", "—"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&hellip;", "…"), ("&middot;", "·"), ("&amp;", "&"))
#: Words of page furniture.
FURNITURE = "版权所有|主办单位|承办单位|网站标识码|ICP备|公网安备|联系我们|网站地图|扫一扫|打印本页|关闭窗口"


def page_text(html: Column, least_cjk: int = 0, furniture: bool = True) -> Column:
    """Visible text of a page: scripts, styles, comments and tags go, block ends break lines, common entities are read.

    With ``least_cjk`` only blocks of so many CJK characters stay; without
    ``furniture`` those with a word of page furniture go.
    """
    c = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?i)</(p|div|h[1-6]|li|tr|article|section)>|<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " ")))
    keep = F.filter(lines, lambda x: (x != "") & (F.regexp_count(x, F.lit("[一-鿿]")) >= least_cjk) & (F.lit(furniture) | ~x.rlike(FURNITURE)))
    return F.array_join(keep, "\n")


def page_links(html: Column) -> Column:
    """Targets of a page's links in order, once each; places within the page and scripts are none."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href=[\"']([^\"'#][^\"']*)[\"']"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: ~F.lower(x).startswith("javascript:")))
