"""Ranked text search over pages (title, text, tags, url): parsing, scores, highlights, snippets and paging."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_links

# Words that a standard search leaves out, and the weights of a match.
STOP_WORDS = frozenset(
    """
a about above after again against all am an and any are aren't as at be because been before being below between both but by can't cannot could
couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her
here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no
nor not of off on once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that
that's the their theirs them themselves then there there's these they they'd they'll they're they've this those through to too under until up very was
wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with won't would wouldn't you
you'd you'll you're you've your yours yourself yourselves
""".split()
)
TITLE, TEXT, TAGS, URL = 20, 20, 10, 20
SHOW, LEAST, WORDS = 10, 3, 25
MARK = '<span class="SearchResults__highlight">'


@dataclass(frozen=True)
class Query:
    """A parsed search. problem: None, `stop words` or `too short`."""

    terms: tuple[str, ...]
    phrase: bool = False
    had_stop_words: bool = False
    problem: str | None = None
    literal: bool = field(default=False)

    def pattern(self, term: str) -> str:
        return f"\\Q{term}\\E" if self.literal else term


def parse(text: str, least: int = LEAST, literal: bool = False) -> Query:
    """Parse what was typed. Wrapped in like quotes it is a phrase; else stop words go, and -term excludes.

    Empty tokens and a lone - are dropped, where the studied source lets them match everywhere.
    """
    said = text.strip().lower()
    if len(said) > 1 and said[0] == said[-1] and said[0] in "\"'":
        inner = said[1:-1]
        return Query((inner,), True, False, None if len(inner) >= least else "too short", literal)
    words = [w for w in said.split(" ") if w]
    kept = [w for w in words if w not in STOP_WORDS]
    dropped = len(kept) < len(words)
    problem = None if len(" ".join(kept)) >= least else "stop words" if dropped else "too short"
    return Query(tuple(w for w in kept if w != "-"), False, dropped, problem, literal)


def _hits(column: str, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(f"(?i){pattern}"))


def term_score(pattern: str) -> Column:
    """Weighted hits of one pattern in title, text and tags, and the url's weight if it matches at all."""
    url = F.when(F.coalesce(F.col("url"), F.lit("")).rlike(f"(?i){pattern}"), URL).otherwise(0)
    return TITLE * _hits("title", pattern) + TEXT * _hits("text", pattern) + TAGS * _hits("tags", pattern) + url


def score(query: Query) -> Column:
    """Sum over terms, in order; a -term that matches title, text or tags puts the sum back to zero at its place."""
    total: Column = F.lit(0)
    for term in query.terms:
        if term.startswith("-") and not query.phrase:
            pattern = query.pattern(term[1:])
            seen = _hits("title", pattern) + _hits("text", pattern) + _hits("tags", pattern) > 0
            total = F.when(seen, 0).otherwise(total)
        else:
            total = total + term_score(query.pattern(term))
    return total.cast("long")


def highlight(query: Query, column: str = "text", every: bool = False) -> Column:
    """Each positive term's first match (or every one) marked, one term after the other. A phrase is not marked."""
    out = F.col(column)
    for term in query.terms if not query.phrase else ():
        if not term.startswith("-"):
            pattern = query.pattern(term)
            out = F.regexp_replace(out, f"(?i)({pattern})", f"{MARK}$1</span>") if every else F.regexp_replace(out, f"(?is)\\A(.*?)({pattern})", f"$1{MARK}$2</span>")
    return out


def snippet(column: Column, words: int = WORDS) -> Column:
    """The first words, split at blanks; ` ...` follows unless they end in a full stop. Empty stays empty."""
    cut = F.trim(F.array_join(F.slice(F.split(column, " ", -1), 1, words), " "))
    return F.when(cut == "", "").when(cut.endswith("."), cut).otherwise(F.concat(cut, F.lit(" ...")))


def matches(pages: DataFrame, text: str, lang: str | None = None, least: int = LEAST, literal: bool = False) -> DataFrame:
    """The rows of pages with a score over zero, and their score. lang keeps urls below that folder. No rows if the search has a problem."""
    query = parse(text, least, literal)
    if lang:
        pages = pages.where(F.startswith(F.col("url"), F.lit(f"{lang}/")))
    if query.problem or not query.terms:
        return pages.withColumn("score", F.lit(0).cast("long")).where(F.lit(False))
    return pages.withColumn("score", score(query)).where("score <> 0")


def search(pages: DataFrame, text: str, start: int = 0, show: int = SHOW, lang: str | None = None, literal: bool = False, tie: str = "pos") -> DataFrame:
    """One page of results (score, title, snippet, url), best first, ties by the column `tie`."""
    query = parse(text, literal=literal)
    found = matches(pages, text, lang, literal=literal).orderBy(F.desc("score"), F.asc(tie)).offset(start).limit(show)
    return found.select("score", "title", snippet(highlight(query)).alias("snippet"), "url")


def count_and_links(pages: DataFrame, text: str, start: int = 0, show: int = SHOW) -> DataFrame:
    """(n, links): number of results and the pages to link to."""
    n = matches(pages, text).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("links", F.when(F.col("n") > show, page_links(F.col("n"), F.lit(start), show)).otherwise(F.array().cast("array<int>")))
