"""Text that may be shown: without paths of the machine, without secrets, on one line and within a number of bytes.

Paths are read by a small grammar. A stretch is what a path may consist of, spaces inside it included; it ends where a
quote, a line, a bracket or a mark of punctuation ends it. A path begins with a drive, with two slashes, or with a slash
that no name stands before, or it climbs: one of its segments is ``..``. Climbing paths go first, for a relative one may
have an absolute one's look further on. Secrets are read by labels: what stands behind one is hidden up to where its
value ends.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of secrets (a space stands for an optional -, _ or space), first letters of keys, words before a
# path in messages, and what stands in the place of what is hidden.
NAMED = ("api key", "access token", "refresh token", "token", "password", "secret", "credential", "connection string")
KEYS = ("sk", "ghp", "github_pat", "xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-", "AIza")
VERBS = ("read", "open", "resolve", "watch", "parse")
HIDDEN, HIDDEN_PATH, MORE = "[REDACTED]", "[path-redacted]", "... [truncated]"
# Characters of a text that are looked at, and bytes of what is shown.
INPUT_CHARS, MESSAGE_BYTES = 8192, 2048

MARK = r"\[REDACTED\]"
QUOTES, LINES = "\"'`", r"\r\n"


def one_of(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(w.replace(" ", "[-_ ]?") for w in words) + ")"


def _stretch(ends: str) -> str:
    """A run of characters but ``ends``, points and blanks; points and blanks only inside it."""
    plain = rf"[^{QUOTES}{LINES}\s.{ends}]"
    return rf"(?:\s*+(?:{plain}|\.(?!\s|$)))"


#: Of absolute paths, a colon is a part unless a blank or the end follows it; climbing paths hold no colon.
INSIDE = "(?:" + _stretch(r";:,)\]}") + r"|\s*+:(?!\s|$))*+"
CLIMB, TAIL = r"\.\.[\\/]", _stretch(r";:,)\]}") + "*+"
#: A run that may hold blanks, before the segment that climbs, and that segment's own name.
LOOSE, NAME = rf"[^{QUOTES}{LINES}:;,]*", rf"[^{QUOTES}{LINES}:;,/\\]+[\\/]"


def _climbing() -> list[tuple[str, str]]:
    """Patterns and what takes their place, in order."""
    keep = "$1" + HIDDEN_PATH
    labelled = rf"([=:]\s+){LOOSE}[ \t]{NAME}{CLIMB}{TAIL}"
    told = rf"(?i)(\b{one_of(VERBS)}\s+){LOOSE}[\\/]{CLIMB}{TAIL}"
    spaced = rf"(?<=\s){LOOSE}[ \t]{NAME}{CLIMB}{TAIL}"
    segment = rf"[^\s{QUOTES}:/${{}}\\]"
    alone = rf"(?<!{segment})(?:{segment}++[\\/])+{CLIMB}{TAIL}|(?<![^\s(]){CLIMB}{TAIL}"
    quoted = rf"(?<=[{QUOTES}])(?:[^{QUOTES}{LINES}]*[\\/])?{CLIMB}[^{QUOTES}{LINES}]*(?=[{QUOTES}])"
    return [(quoted, HIDDEN_PATH), (labelled, keep), (told, keep), (spaced, HIDDEN_PATH), (alone, HIDDEN_PATH)]


ABSOLUTE = rf"(?:\b[A-Za-z]:|\\\\|//|(?<![\w./-])/(?!/)){INSIDE}"


def _secrets() -> list[tuple[str, str]]:
    line = rf"(?:{MARK}|[^{LINES};]+)"
    value = rf"(?!{MARK})(?:\"[^\"]*\"|'[^']*'|[^\s,;}}\]]+)"
    return [
        (rf"(?i)\b(authorization[ \t]*[:=][ \t]*){line}", "$1" + HIDDEN),
        (rf"(?i)\bbearer[ \t]+{line}", "Bearer " + HIDDEN),
        (rf"(?i)\b({one_of(NAMED)})\b\s*[:=]\s*{value}", "$1=" + HIDDEN),
        (rf"(?<=\w://)[^\s{QUOTES}]+@", HIDDEN + "@"),
        (rf"\b{one_of(KEYS)}[\w-]{{8,}}\b", HIDDEN),
    ]


def _replaced(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def without_secrets(c: Column) -> Column:
    """Values of named secrets, authorization, what signs in to an address, and keys by their first letters are hidden."""
    return _replaced(c, _secrets())


def without_paths(c: Column) -> Column:
    """Absolute paths and paths that climb are hidden."""
    c = F.when(c.rlike(CLIMB), _replaced(c, _climbing())).otherwise(c)
    return F.regexp_replace(c, ABSOLUTE, HIDDEN_PATH)


def redacted(c: Column) -> Column:
    """Text that may be shown: no paths, then no secrets."""
    return without_secrets(without_paths(c))


def truncated_bytes(c: Column, most: int) -> Column:
    """At most ``most`` UTF-8 bytes, cut between characters, with a mark if something is missing."""
    room = most - len(MORE)
    # as many bytes as fit; a character that the cut splits is dropped, which is at most three bytes
    raw = F.substring(F.encode(c, "UTF-8"), 1, room)
    whole = F.coalesce(*[F.when(F.is_valid_utf8(F.substring(raw, 1, room - i)), F.decode(F.substring(raw, 1, room - i), "UTF-8")) for i in range(4)])
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(whole, F.lit(MORE)))


def public_text(c: Column, chars: int = INPUT_CHARS, most: int = MESSAGE_BYTES) -> Column:
    """A message for everybody: its first ``chars`` characters on one line, redacted, within ``most`` bytes."""
    return truncated_bytes(redacted(F.regexp_replace(F.substring(c, 1, chars), "[\x00-\x1f\x7f]", " ")), most)
