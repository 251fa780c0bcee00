"""The language policy of a session as one ordered rule table, shared by batch and stream.

A turn is a dict of features (see ``operators.turns.language_features``); a state is a dict of
locked, first_unambiguous, pending_codes and pending_query. A turn and its state become a set of facts; the first
rule whose facts all hold (a leading ``-`` asks for the opposite) decides.
"""

from __future__ import annotations

from typing import NamedTuple

from corpusflow.defaults import CORE_LANGUAGES

FALLBACK = "de"
UNRECOGNIZED = "en"
_CORE = frozenset(CORE_LANGUAGES)


class Rule(NamedTuple):
    facts: str
    #: german, english, choice, hint (the preferred one, else german), lock or code
    language: str
    source: str
    #: whether the language is locked, and first_unambiguous after it: +, -, blank for unchanged; "hint": locked, -, if there is one
    lock: str
    #: own text or the pending query
    text: str = "own"


RULES = [
    # a choice of languages was offered before
    Rule("waiting strange", "english", "unrecognized_en", "", "older"),
    Rule("waiting chose cue", "choice", "choice", "lock-"),
    Rule("waiting chose", "choice", "choice", "lock-", "older"),
    Rule("waiting yes", "hint", "choice_default", "lock-", "older"),
    Rule("waiting -cue", "hint", "choice_default", "lock-", "older"),
    Rule("-waiting strange", "english", "unrecognized_en", ""),
    # the session has its language
    Rule("locked shared", "lock", "sticky", "lock"),
    Rule("locked sticky", "lock", "sticky", "lock"),
    Rule("locked known other -core cue", "lock", "sticky", "lock"),
    Rule("locked known other", "code", "switched", "lock+"),
    Rule("locked known coded", "code", "detected", "lock"),
    Rule("locked", "lock", "sticky", "lock"),
    # a first turn, or a new question in place of a choice
    Rule("marker", "german", "german_marker", "lock+"),
    Rule("chose -cue", "choice", "choice", "lock+"),
    Rule("shared", "hint", "shared_vocab", "hint"),
    Rule("cue -core", "hint", "hotel_fallback", "hint"),
    Rule("two_core_close", "hint", "ambiguous_core", "hint"),
    Rule("two_close -core", "hint", "ambiguous_fallback", "hint"),
    Rule("known core", "code", "detected", "lock+"),
    Rule("", "hint", "fallback_de", "hint"),
]
_TABLE = [(frozenset(f for f in r.facts.split() if f[0] != "-"), frozenset(f[1:] for f in r.facts.split() if f[0] == "-"), r) for r in RULES]


def empty_state() -> dict:
    return {"locked": None, "first_unambiguous": False, "pending_codes": None, "pending_query": None}


def facts_of(state: dict, turn: dict) -> set[str]:
    waiting, lock, code = bool(state["pending_codes"]), state["locked"], turn["code"]
    tests = {
        "waiting": waiting, "locked": bool(lock) and not waiting, "strange": turn["unrecognized"], "chose": turn["choice"] is not None,
        "yes": turn["affirmative"], "known": not turn["unknown"], "coded": bool(code), "core": code is not None and code.lower() in _CORE,
        "other": bool(code) and bool(lock) and code.lower() != lock.lower(), "sticky": bool(lock) and lock.lower() in turn["sticky"],
        "two_close": len(turn["close"]) >= 2, "two_core_close": sum(c.lower() in _CORE for c in turn["close"]) >= 2,
        **{name: turn[name] for name in ("cue", "marker", "shared")},
    }
    return {name for name, holds in tests.items() if holds}


def step(state: dict, turn: dict):
    """-> (state, language, source, text to process); every decision clears what was pending."""
    facts = facts_of(state, turn)
    rule = next(r for needed, barred, r in _TABLE if needed <= facts and not barred & facts)
    hint = turn["hint"]
    language = {"german": FALLBACK, "english": UNRECOGNIZED, "choice": turn["choice"], "hint": hint or FALLBACK,
                "lock": state["locked"], "code": turn["code"]}[rule.language]
    effect = ("lock-" if hint is not None else "") if rule.lock == "hint" else rule.lock
    after = dict(state, pending_codes=None, pending_query=None)
    if effect:
        after["locked"] = language
    if effect[4:]:
        after["first_unambiguous"] = effect[4:] == "+"
    older = state["pending_query"] if state["pending_query"] is not None else turn["text"]
    return after, language, rule.source, older if rule.text == "older" else turn["text"]


ANY = "*"


class Summary:
    """What a run of turns does to any incoming lock, so that segments can be combined.

    Without anything pending, a turn depends on the state only through "locked or not" and
    through whether the lock is in the turn's sticky set. Locks never named there behave alike
    and share the entry ANY; ``end[start] = (lock, flag)`` with None for "unchanged".
    """

    def __init__(self):
        self.end: dict = {None: (None, None), ANY: (ANY, None)}

    def _split(self, code: str) -> None:
        if code not in self.end:
            lock, flag = self.end[ANY]
            self.end[code] = (code if lock == ANY else lock, flag)

    def add(self, turn: dict) -> None:
        if turn["unrecognized"]:
            return
        for code in turn["sticky"]:
            self._split(code)
        if turn["code"]:
            self._split(turn["code"])
        for start, (lock, flag) in list(self.end.items()):
            if lock == ANY:  # a lock that no sticky set of this segment names
                state = {"locked": "\0", "first_unambiguous": None, "pending_codes": None, "pending_query": None}
            else:
                state = {"locked": lock, "first_unambiguous": None, "pending_codes": None, "pending_query": None}
            after = step(state, turn)[0]
            new_flag = after["first_unambiguous"] if after["first_unambiguous"] is not None else flag
            self.end[start] = (ANY if after["locked"] == "\0" else after["locked"], new_flag)

    def apply(self, lock: str | None, flag: bool) -> tuple[str | None, bool]:
        end, new_flag = self.end[lock] if lock in self.end else self.end[ANY]
        return (lock if end == ANY else end), (flag if new_flag is None else new_flag)
