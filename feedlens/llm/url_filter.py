"""URL filter: rules by host and path, then a weighted vocabulary found by Aho-Corasick.

The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or
the end, A-Z lower-cased; the path follows, up to ``?``, ``#`` or the end.  A
rule (``host/path``) fits its host and all its subdomains if the path starts
with the rule's; the longest fitting rule decides.

Without a rule the vocabulary decides, over the whole url in lower case: a term
counts where no ASCII letter or digit touches it.  One strict term rejects, and
so do ``SOFT_LIMIT`` distinct soft terms.  All terms are found in one pass over
the url, whatever their number.

Defined cases: a null url, or one without ``://``, has empty host and path and
no rule (an empty path starts with no rule's); a null url has no terms and is
allowed; rows are judged each on its own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

# Vocabulary (fixed values).  One strict term is enough.
STRICT = ("porn", "porno", "pornhub", "xxx", "xnxx", "hentai", "escort", "camgirls", "sexcam", "viagra", "cialis",
          "casino", "casinos", "warez", "keygen", "crackz", "phishing", "malware")
# Soft terms are ordinary words that add up.
SOFT = ("sex", "adult", "nude", "erotic", "dating", "singles", "cheap", "discount", "pills", "pharmacy", "drugs",
        "bet", "betting", "poker", "slots", "bonus", "jackpot", "lottery", "loan", "loans", "payday", "crypto",
        "free", "win", "winner", "prize", "replica", "rolex", "spam", "farm", "clickbait", "torrent", "crack",
        "download", "hacked", "seo", "backlinks", "proxy")
SOFT_LIMIT = 2

_HOST_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _HOST_PATH, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _HOST_PATH, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, else null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        hit = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def automaton(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for weight, terms in ((0, soft), (1, strict)):
        for t in terms:
            a.add_word(t, (weight, t))
    a.make_automaton()
    return a


def _alnum(c: str) -> bool:
    return c.isascii() and c.isalnum()


def term_counts(url: str, a: ahocorasick.Automaton) -> tuple[int, int]:
    """Distinct strict and soft terms that stand free in a lower-cased url."""
    found = set()
    for end, (weight, term) in a.iter(url):
        start = end + 1 - len(term)
        if (start == 0 or not _alnum(url[start - 1])) and (end + 1 == len(url) or not _alnum(url[end + 1])):
            found.add((weight, term))
    strict = sum(w for w, _ in found)
    return strict, len(found) - strict


_COUNTS = StructType([StructField("n_strict", IntegerType()), StructField("n_soft", IntegerType())])


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] = STRICT,
                soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """Per page (page_id, host, path, rule, verdict, n_strict, n_soft)."""
    terms = (tuple(strict), tuple(soft))

    @F.pandas_udf(_COUNTS)
    def counts(urls: pd.Series) -> pd.DataFrame:
        a = automaton(*terms)
        return pd.DataFrame([term_counts(u or "", a) for u in urls], columns=["n_strict", "n_soft"], dtype="int32")

    lower = ascii_lower(F.coalesce(F.col("url"), F.lit("")))
    judged = (pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                           counts(lower).alias("terms"))
              .withColumn("hit", rule_for(F.col("host"), F.col("path"), rules)))
    own = F.when((F.col("terms.n_strict") > 0) | (F.col("terms.n_soft") >= soft_limit), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                         F.coalesce("hit.verdict", own).alias("verdict"), "terms.n_strict", "terms.n_soft")
