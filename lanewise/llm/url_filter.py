"""URL verdicts: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

A term counts where no letter or digit stands on either side of it. A strict
term weighs as much as the limit, a soft one 1; the weights of the distinct
terms of a URL are summed, so one strict or ``SOFT_LIMIT`` different soft terms
block it.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parameters: verdict, host, path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
STRICT = ("casino", "porn", "spam-farm", "spamfarm", "viagra", "xxx")
SOFT = ("ad", "ads", "banner", "bet", "bonus", "click", "deal", "free", "poker", "promo", "sex", "track", "utm_source", "win")
SOFT_LIMIT = 2
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_LOWER), slash + path


class Vocabulary:
    def __init__(self, strict: tuple[str, ...], soft: tuple[str, ...], limit: int):
        self.weights = dict.fromkeys(soft, 1) | dict.fromkeys(strict, limit)
        self.limit = limit
        self.terms = ahocorasick.Automaton()
        for term in self.weights:
            self.terms.add_word(term, term)
        if self.weights:
            self.terms.make_automaton()

    def hits(self, text: str) -> set[str]:
        """The distinct terms that stand alone in a text in lower case."""
        found = set()
        for end, term in self.terms.iter(text) if self.weights else ():
            start = end - len(term) + 1
            if (not start or text[start - 1] not in _LETTERS) and (end + 1 == len(text) or text[end + 1] not in _LETTERS):
                found.add(term)
        return found


def judge_urls(
    pages: DataFrame,
    rules: tuple = RULES,
    strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT,
    limit: int = SOFT_LIMIT,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_terms and soft_terms (distinct) of every row.

    A rule fits its host and all subdomains, if the path starts with the
    rule's; the longest rule wins, then the first by name. Null URLs and those
    without ``://`` have an empty host and path and no rule; the vocabulary
    judges the whole URL (null: empty). Null ids stay; repeated rows give equal
    rows; further columns are ignored; an empty table gives an empty result.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    strict_terms = frozenset(strict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(strict, soft, limit)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                rule = next(
                    (r for r in ordered if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), None
                )
                found = vocabulary.hits((url or "").translate(_LOWER))
                weight = sum(vocabulary.weights[t] for t in found)
                verdict = rule[0] if rule else ("block" if weight >= limit else "allow")
                hard = len(found & strict_terms)
                row = (host, path, rule and rule[1] + rule[2], verdict, hard, len(found) - hard)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            names = ["page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    return rows.mapInArrow(
        run, "page_id long, host string, path string, rule string, verdict string, strict_terms int, soft_terms int"
    )
