"""URL filter: explicit host/path rules first, then a weighted vocabulary counted with Aho-Corasick.

One automaton holds every term. A hit counts only between boundaries (no ASCII letter or digit on
either side). One strict term rejects a url, and so do ``soft_limit`` different soft terms.

Defined results: a null url, or one without ``://``, has an empty host and path and so no rule; the
vocabulary still reads whatever text there is (null: no hit, allowed). Repeated rows are judged each by
itself. A url of any length is read whole. Columns other than the url pass through.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower

# The default vocabulary. A strict term is enough alone, soft terms only together.
STRICT = ("adult", "casino", "cialis", "escort", "hentai", "malware", "phishing", "porn", "spam", "viagra",
          "warez", "xxx")
SOFT = ("bet", "bets", "bonus", "cheap", "deal", "deals", "dating", "free", "jackpot", "loan", "pill", "pills",
        "poker", "replica", "sex", "slots", "win")
ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with all its subdomains and the paths that begin like ``path``."""
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton | None:
    machine = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):
        for t in terms:
            machine.add_word(t, (kind, t))
    if not len(machine):
        return None
    machine.make_automaton()
    return machine


def term_hits(text: str | None, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """Different strict and soft terms of one lower-cased url."""
    machine, found = _automaton(strict, soft), {"strict": set(), "soft": set()}
    if text and machine is not None:
        for end, (kind, term) in machine.iter(text):
            start = end - len(term) + 1
            if (start == 0 or text[start - 1] not in ALNUM) and (end + 1 == len(text) or text[end + 1] not in ALNUM):
                found[kind].add(term)
    return len(found["strict"]), len(found["soft"])


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _best_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    picked = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        picked = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(picked)
    return picked


def judge_urls(df: DataFrame, rules: Sequence[Rule] = (), url: str = "url", strict: Sequence[str] = STRICT,
               soft: Sequence[str] = SOFT, soft_limit: int = 2) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``n_strict``, ``n_soft`` and ``verdict`` to every row."""
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("struct<strict:int,soft:int>")
    def hits(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([term_hits(u, strict, soft) for u in urls], columns=["strict", "soft"], dtype="int32")

    host, path = host_of(F.col(url)), path_of(F.col(url))
    found = hits(ascii_lower(url))
    by_terms = F.when((found["strict"] >= 1) | (found["soft"] >= soft_limit), "block").otherwise("allow")
    best = _best_rule(rules, host, path)
    return df.withColumns({
        "host": host, "path": path, "rule": best["rule"], "n_strict": found["strict"], "n_soft": found["soft"],
        "verdict": F.coalesce(best["verdict"], by_terms)})
