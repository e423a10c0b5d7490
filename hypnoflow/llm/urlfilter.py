"""Verdicts on addresses: host and path rules, and a weighted vocabulary found by Aho-Corasick.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, its letters A-Z in lower case; the path goes on to
`?`, `#` or the end. A rule names a host and a path; it fits that host and all its subdomains where the address's path begins with
the rule's. Of the rules that fit, the longest decides (of two equally long ones that of the longer host).

Where no rule fits, the vocabulary decides. One automaton holds all terms, strict and soft, and runs once over host and path, lower-cased
and with %-escapes decoded; a hit counts only between boundaries, which is where the character before and the one after are no
letters or digits. Strict terms weigh REJECT, soft ones 1, each distinct term once; a sum of REJECT or more blocks, so one
strict term does, and so do several distinct soft ones, while one soft term, however often, does not. The query string is not looked at, for it
often names other sites.

Defined results: an address that is null or has no `://` has an empty host and path, no rule and no terms, and is allowed;
rows that repeat are judged each; columns of the result's names are replaced, whatever their case; other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import without

#: Words that on their own say that a site is not wanted, and words that do so together with another one.
STRICT = ("casino", "casinos", "porn", "porno", "xxx", "hentai", "milf", "viagra", "cialis", "spam", "malware", "warez")
SOFT = (
    "ads", "adult", "bet", "bets", "betting", "bonus", "cam", "cams", "cheap", "click", "coupon", "dating", "deals", "escort", "farm", "free", "gambling", "hot", "jackpot", "loan",
    "loans", "lottery", "nude", "pharmacy", "pill", "pills", "poker", "popunder", "prize", "replica", "sex", "sexy", "slots", "torrent", "track", "tracker", "win", "winner", "x",
)
#: The weight that blocks, and that of a strict term; a soft one weighs 1.
REJECT = 2

_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of an address; both empty where it has none."""
    found = _PARTS.search(url or "")
    return (found[1].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), found[2]) if found else ("", "")


class Rules:
    """Rules by host; a look-up takes one step for each label of the host, however many rules there are."""

    def __init__(self, rules: Sequence[tuple[str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, rule in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"a rule allows or blocks, not {verdict}")
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.lower(), []).append((slash + path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule that decides, and its verdict."""
        fitting, at = [], 0
        while True:
            suffix = host[at:]
            fitting += [(len(suffix + start), len(suffix), suffix + start, verdict) for start, verdict in self.by_host.get(suffix, ()) if path.startswith(start)]
            dot = host.find(".", at)
            if dot < 0:
                return max(fitting)[2:] if fitting else None
            at = dot + 1


class Vocabulary:
    """The automaton over all terms, and the terms with their boundaries."""

    def __init__(self, strict: Sequence[str], soft: Sequence[str]) -> None:
        self.found = ahocorasick.Automaton()
        for kind, terms in (("soft", soft), ("strict", strict)):  # a term in both lists is strict
            for term in terms:
                if not term:
                    raise ValueError("a term is not empty")
                self.found.add_word(term.lower(), (kind, term.lower()))
        self.found.make_automaton()

    def hits(self, text: str) -> tuple[list[str], list[str]]:
        """The distinct strict and soft terms of a text that stand between boundaries, in order of the alphabet."""
        out: dict[str, set[str]] = {"strict": set(), "soft": set()}
        if self.found.kind == ahocorasick.AHOCORASICK:
            for end, (kind, term) in self.found.iter(text):
                before, after = end - len(term), end + 1
                if not (before >= 0 and text[before].isalnum()) and not (after < len(text) and text[after].isalnum()):
                    out[kind].add(term)
        return sorted(out["strict"]), sorted(out["soft"])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = (), strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, url: str = "url") -> DataFrame:
    """pages with host, path, rule (the one that decides, else null), verdict (allow or block), strict_terms and soft_terms.

    rules: (verdict, host and path) pairs, such as ("block", "example.com/en/"). Rules and terms travel with the tasks.
    """
    own = without(pages, "host", "path", "rule", "verdict", "strict_terms", "soft_terms")
    added = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")] + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("strict_terms", "soft_terms")]
    names = [*own.columns, *(f.name for f in added)]
    at = own.columns.index(url)
    rules, strict, soft = list(rules), list(strict), list(soft)
    Rules(rules)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host, words = Rules(rules), Vocabulary(strict, soft)
        for batch in batches:
            rows = []
            for address in batch.column(at).to_pylist():
                host, path = parts(address)
                hard, mild = words.hits(unquote(host + path).lower())
                rule = by_host.find(host, path)
                blocked = REJECT * len(hard) + len(mild) >= REJECT
                rows.append((host, path, rule and rule[0], rule[1] if rule else "block" if blocked else "allow", hard, mild))
            kinds = [*[pa.string()] * 4, *[pa.list_(pa.string())] * 2]
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names)

    return own.mapInArrow(of, T.StructType([*own.schema.fields, *added]))
