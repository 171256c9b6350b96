"""Secrets in texts: those that are known, and those that a form or a name gives away."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

SHOWN = "[REDACTED]"

# Names of fields that hold a secret, and those of them that don't by themselves make one in running text.
NAMES = ("access_token", "api_key", "authorization", "client_secret", "key", "password", "refresh_token", "secret", "secret_key", "token")
ONLY_FIELDS = ("authorization",)
ONLY_PARAMETERS = ("key", "token")


def _any(names) -> str:
    return "(?:" + "|".join(n.replace("_", "[-_]?") for n in names) + ")"


IN_QUERY = _any(n for n in NAMES if n not in ONLY_FIELDS)
IN_TEXT = _any(n for n in NAMES if n not in ONLY_FIELDS + ONLY_PARAMETERS)

#: A user in front of a host, what a bearer shows, a parameter of a URL, and a value behind a name; each up to the end of the secret.
FORMS = (
    (r"(https?://)[^/\s@]+(@)", rf"$1{SHOWN}$2"),
    (r"(?i)(bearer\s+)[^\s\"']+", rf"$1{SHOWN}"),
    (rf"(?i)([?&]{IN_QUERY}=)[^&#\s]+", rf"$1{SHOWN}"),
    (rf"(?i)({IN_TEXT}\s*[:=]\s*)[^\s,;]+", rf"$1{SHOWN}"),
)


def _automaton(known: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for secret in known:
        found.add_word(secret, len(secret))
    found.make_automaton()
    return found


def without(known: list[str]):
    """A function of a text column that takes every known secret out, in one pass for all of them; what several of them overlap on goes as one."""
    given = sorted({s for s in known if s})

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        automaton = _automaton(given)

        def shown(text: str) -> str:
            spans: list[list[int]] = []
            for end, size in automaton.iter(text):
                begin = end + 1 - size
                while spans and spans[-1][1] > begin:
                    begin = min(begin, spans.pop()[0])
                spans.append([begin, end + 1])
            out, at = [], 0
            for b, e in spans:
                out += [text[at:b], SHOWN]
                at = e
            return "".join(out) + text[at:]

        return texts.map(shown, na_action="ignore").astype(object)

    return run if given else lambda c: c


def redact(text: Column | str, known: list[str] | None = None) -> Column:
    """The text without known secrets, users in URLs, bearers' tokens and values behind secret names; null stays null."""
    c = F.col(text) if isinstance(text, str) else text
    c = without(known)(c) if known else c
    for form, shown in FORMS:
        c = F.regexp_replace(c, form, shown)
    return c


def redact_keys(values: Column | str, known: list[str] | None = None) -> Column:
    """A map with the values of secret names replaced (the whole name, in any case, - as _) and other values redacted; null values of other names stay null."""
    c = F.col(values) if isinstance(values, str) else values
    secret = lambda k: F.replace(F.lower(k), F.lit("-"), F.lit("_")).isin(*NAMES)
    if not known:
        return F.transform_values(c, lambda k, v: F.when(secret(k), F.lit(SHOWN)).otherwise(redact(v)))
    # a Python function can't run within an array's lambda: the map goes through it as one text
    told = F.from_json(without([_quoted(s) for s in known])(F.to_json(c)), "map<string,string>")
    return F.transform_values(told, lambda k, v: F.when(secret(k), F.lit(SHOWN)).otherwise(redact(v)))


def _quoted(secret: str) -> str:
    import json

    return json.dumps(secret, ensure_ascii=False)[1:-1]


def holds(text: Column | str, known: list[str]) -> Column:
    """Whether a text holds any known secret; never null."""
    c = F.col(text) if isinstance(text, str) else text
    return ~F.coalesce(without(known)(c).eqNullSafe(c), F.lit(True))
