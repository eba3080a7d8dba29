"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Fixed patterns give the base spans. Looser patterns give candidates, also those that fail a base test.
Labelers (format, gazetteer, context, surroundings, letters, denial) vote for, against, or not on each candidate.
Expectation-maximisation estimates, from counts of vote patterns over all documents, how often each
labeler says what about real and unreal spans; its posteriors train a logistic classifier of spans on
votes, kind, length and share of digits. Candidates it accepts are added where they overlap no base span.

Documents are scanned once; spans and candidates are stored by row, without texts. A candidate's votes
and features form a cell; cells are few whatever the corpus (kinds x votes x buckets), so their counts are
all that reaches the driver. The last step reads the stored spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.tables import slices, stored, texts

# Kinds in the order of results, and the base patterns.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "local_phone", "national_id", "secret")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number that starts inside a longer one fails where the longer one does.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Looser patterns of candidates.
LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")
NATIONAL_ID = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
# What may stand between a sign and its value, and a value: however long, it is one to its end.
LEAD = re.compile(r"""[\x20"']*+""")
VALUE = re.compile(r"""[^\s"',;]*+""")
LEAST_VALUE = 8
ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])[A-Z]{4}[A-Z0-9]{16}(?![A-Za-z0-9])")

#: Keys that name their issuer in their first letters.
ISSUED_KEY = re.compile(
    r"(?<![A-Za-z0-9])(?:gh[opsu]_|github_pat_|glpat-|xox[abpr]-|AIza|[rs]k_live_|[rs]k_test_|npm_|pypi-|hf_|SG\.)"
    r"[A-Za-z0-9_.-]{16,}+"
)

# Gazetteers and context words of the labelers.
TOP_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post "
    "io co me tv cc ai app dev cloud online site shop store tech blog news xyz top club page wiki zone agency "
    "ar at au be bg br ca ch cl cn cy cz de dk ee es eu fi fr gr hk hr hu id ie il in ir is it jp kr kz lt "
    "lu lv ma mt mx my ng nl no nz pe ph pk pl pt ro rs ru sa se sg si sk th tr tw ua uk us uy ve vn za".split()
)
KEY_PREFIXES = frozenset(
    "AKIA ASIA AGPA AIDA AROA AIPA ANPA ANVA ABIA ACCA gho_ ghp_ ghs_ ghu_ gith glpa xoxa xoxb xoxp xoxr AIza "
    "sk_l sk_t rk_l rk_t npm_ pypi hf_ eyJh eyJ0 eyJr".split()
)
SECRET_NAMES = frozenset(
    "password passwd passphrase passcode pwd pass secret token apikey api_key api-key access_key access-key "
    "auth_token auth-token client_secret private_key credential credentials bearer authorization session "
    "cookie key pin".split()
)
EASY_CODES = frozenset(f"{d}{d}{d}" for d in range(10)) | {"123", "000", "555"}
_CALLS = "phone tel telephone call called calling dial mobile cell cellphone fax text sms whatsapp hotline contact"
CONTEXT = {
    "email": frozenset("mail email e-mail mailto contact write address reach send reply inbox to from cc".split()),
    "ip": frozenset("ip ipv host address addr server client from peer gateway dns subnet ping ssh login".split()),
    "card": frozenset("card visa mastercard amex credit debit payment account pay cvv expiry charged".split()),
    "phone": frozenset(_CALLS.split()),
    "local_phone": frozenset(_CALLS.split()),
    "national_id": frozenset("ssn social security id identity insurance national taxpayer tin sin".split()),
    "secret": SECRET_NAMES,
}
AGAINST = frozenset(
    "version release page section figure table isbn issn doi order chapter no number build part item invoice "
    "serial model batch lot row line step score id_ port".split()
)
LABELERS = ("format", "gazetteer", "context", "surroundings", "letters", "denial")

#: Spans that the rates over all kinds count like when those of one kind are estimated.
OWN_TRUST = 500.0

#: Number of digits, whether it holds a letter, number of distinct characters of a span.
Content = tuple[int, bool, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the base pattern, one '@' after the other: all starts before it share its end."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def only_digits(part: str) -> str:
    return "".join(c for c in part if "0" <= c <= "9")


def numbers(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, passes) of every match of the base patterns with digits."""
    for m in IP.finditer(text):
        yield "ip", *m.span(), all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))
    for m in CARD.finditer(text):
        digits = only_digits(m[0])
        if len(digits) >= 8:  # shorter numbers are no candidates either
            yield "card", *m.span(), 12 <= len(digits) <= 19 and luhn(digits)
    for m in PHONE.finditer(text):
        yield "phone", *m.span(), 9 <= len(only_digits(m[0])) <= 15


def spans_of(text: str) -> tuple[list, list]:
    """Base spans (kind number, start, end), and candidates (the same and their cell)."""
    base, loose = [], []
    for start, end in emails(text):
        base.append((0, start, end))
    if re.search("[0-9]", text):
        for kind, start, end, passes in numbers(text):
            (base if passes else loose).append((KINDS.index(kind), start, end))
        loose += [(4, *m.span()) for m in LOCAL_PHONE.finditer(text)]
        loose += [(5, *m.span()) for m in NATIONAL_ID.finditer(text)]
    loose += [(6, *m.span()) for p in (ACCESS_KEY, ISSUED_KEY) for m in p.finditer(text)]
    assigned = list(assignments(text))
    loose += [(6, *s) for s in assigned]
    valid, known = set(base), contents(text, assigned)
    cells = [
        (*s, cell(text, s, s in valid, known.get(s[1:]) if s[0] == 6 else None))
        for s in sorted(valid | set(loose))
    ]
    return sorted(base, key=lambda s: (s[1], s[0])), cells


def assignments(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every assigned value; values with signs in them share their end, found once."""
    until = 0
    for m in re.finditer("[=:]", text):
        start = LEAD.match(text, m.end()).end()
        if start >= until:
            until = VALUE.match(text, start).end()
        if until - start >= LEAST_VALUE and re.search(
            r"([A-Za-z_-]{3,20})[\x20\"']{0,2}$", text[max(0, m.start() - 24) : m.start()]
        ):
            yield start, until


def contents(text: str, spans: list[tuple[int, int]]) -> dict[tuple[int, int], Content]:
    """Content of spans in order, those of one end nested: every character is read once."""
    out: dict[tuple[int, int], Content] = {}
    digits, letters, distinct, low, last = 0, False, set(), 0, -1
    for start, end in reversed(spans):
        if end != last:
            digits, letters, distinct, low, last = 0, False, set(), end, end
        more = text[start:low]
        digits += count_digits(more)
        letters = letters or any(c.isalpha() for c in more)
        distinct.update(more)
        low = start
        out[start, end] = digits, letters, len(distinct)
    return out


def count_digits(part: str) -> int:
    return sum("0" <= c <= "9" for c in part)


def votes(text: str, span: tuple[int, int, int], valid: bool, content: Content) -> list[int]:
    """1 for, -1 against, 0 no opinion, by labeler."""
    kind, start, end = span
    digits, letters, distinct = content
    name = KINDS[kind]
    # of a secret only its start is looked at
    part = text[start : start + 4] if name == "secret" else text[start:end]
    if name in BASE_KINDS:
        form = 1 if valid else -1
    elif name == "secret":
        form = 1 if digits >= 2 and letters else -1
    else:
        form = 1 if well_formed(name, only_digits(part)) else -1
    listed = {
        "email": part.rpartition(".")[2].lower() in TOP_DOMAINS,
        "phone": part[1] in "123456789",
        "secret": part[:4] in KEY_PREFIXES or part[:3] in KEY_PREFIXES,
        "local_phone": part[:3].strip("(") not in EASY_CODES,
        "national_id": part[:3] not in ("000", "666") and part[:1] != "9",
    }.get(name)
    near = set(re.findall(r"[a-z_-]+", text[max(0, start - 40) : start].lower()))
    context = 1 if near & CONTEXT[name] else -1 if near & AGAINST else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    open_sides = (not left or not left.isalnum()) and (not right or not right.isalnum())
    mixed = -1
    if name == "secret":
        mixed = 1 if distinct >= 8 and digits else -1
    elif name != "email":
        mixed = 1 if len(set(only_digits(part))) >= 3 else -1
    else:
        mixed = 1 if any(c.isalpha() for c in part.partition("@")[0]) else -1
    # the last word before it names another sort of number
    denial = -1 if set(re.findall(r"[a-z_]+", text[max(0, start - 12) : start].lower())[-1:]) & AGAINST else 0
    return [form, 0 if listed is None else 1 if listed else -1, context, 1 if open_sides else -1, mixed, denial]


def well_formed(name: str, digits: str) -> bool:
    """Whether the parts of a local phone number or national id are ones that are given out."""
    if name == "local_phone":
        return len(digits) == 10 and digits[0] in "23456789" and digits[3] in "23456789"
    return len(digits) == 9 and digits[3:5] != "00" and digits[5:] != "0000"


def cell(text: str, span: tuple[int, int, int], valid: bool, content: Content | None = None) -> str:
    """Votes and features of a span in a word: kind, votes, length and digits in buckets."""
    kind, start, end = span
    content = content or contents(text, [(start, end)])[start, end]
    marks = "".join("-0+"[v + 1] for v in votes(text, span, valid, content))
    digits = content[0]
    size = min(4, (end - start) // 8)
    return f"{kind}{marks}{size}{4 * digits // (end - start)}"


def split_cells(cells: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, votes, [length, digits]) of each cell."""
    kind = np.array([int(c[0]) for c in cells])
    vote = np.array([["-0+".index(v) for v in c[1 : 1 + len(LABELERS)]] for c in cells])
    rest = np.array([[int(x) for x in c[1 + len(LABELERS) :]] for c in cells])
    return kind, vote, rest


def first_rates() -> np.ndarray:
    """Labelers that are right four times in five; words against a span are rare before real ones."""
    rates = np.empty((2, len(LABELERS), 3))
    rates[1], rates[0] = (0.15, 0.25, 0.6), (0.6, 0.25, 0.15)
    rates[1, LABELERS.index("context")] = (0.03, 0.4, 0.57)
    denial = LABELERS.index("denial")
    rates[1, denial], rates[0, denial] = (0.01, 0.98, 0.01), (0.4, 0.59, 0.01)
    return rates


def reliabilities(
    vote: np.ndarray,
    counts: np.ndarray,
    rounds: int = 100,
    known: np.ndarray | None = None,
    trust: float = 3.0,
):
    """EM: (share of real spans, rates[real, labeler, vote], posterior of each vote pattern).

    Starts from ``known`` rates (by default ``first_rates``), which count like ``trust`` spans of either sort.
    A labeler without an opinion on a span says nothing about it.
    """
    share = 0.5
    before = first_rates() if known is None else known
    rates = before.copy()
    prior = before if known is not None else np.full_like(before, 1 / 3)
    posterior = np.full(len(vote), 0.5)
    which = np.arange(len(LABELERS))
    for _ in range(rounds):
        log = [np.where(vote == 1, 0.0, np.log(rates[r][which, vote])).sum(axis=1) for r in (0, 1)]
        odds = log[1] - log[0] + np.log(share / (1 - share))
        now = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done = np.abs(now - posterior).max(initial=0) < 1e-9
        posterior = now
        if done:
            break
        for r, weight in ((1, counts * posterior), (0, counts * (1 - posterior))):
            for v in range(3):
                rates[r, :, v] = (weight[:, None] * (vote == v)).sum(axis=0) + trust * prior[r, :, v]
            rates[r] /= rates[r].sum(axis=1, keepdims=True)
        share = float(np.clip((counts @ posterior + 1) / (counts.sum() + 2), 0.01, 0.99))
    return share, rates, posterior


def one_hot(kind: np.ndarray, vote: np.ndarray, rest: np.ndarray) -> np.ndarray:
    parts = [np.eye(len(KINDS))[kind]]
    parts += [np.eye(3)[vote[:, i]] for i in range(vote.shape[1])]
    parts += [np.eye(5)[rest[:, i]] for i in range(rest.shape[1])]
    return np.hstack(parts)


def span_classifier(x: np.ndarray, target: np.ndarray, counts: np.ndarray, rounds: int = 60):
    """Weights of a logistic classifier of weighted cells, by Newton's method with a ridge."""
    weights = np.zeros(x.shape[1])
    mass = counts / counts.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (mass * (p - target)) + 1e-3 * weights
        bend = (x * (mass * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def learn(table: dict[str, int]) -> dict[str, float]:
    """Probability of each cell, from the numbers of its spans in all documents."""
    if not table:
        return {}
    cells = sorted(table)
    counts = np.array([table[c] for c in cells], float)
    kind, vote, rest = split_cells(cells)
    # a labeler may be good at one kind and poor at another: the rates of all kinds, and what a kind adds
    rates = reliabilities(vote, counts)[1]
    posterior = np.empty(len(cells))
    for k in np.unique(kind):
        own = kind == k
        posterior[own] = reliabilities(vote[own], counts[own], known=rates, trust=OWN_TRUST)[2]
    x = one_hot(kind, vote, rest)
    weights = span_classifier(x, posterior, counts)
    p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
    return dict(zip(cells, p.tolist()))


def choose(base: list[dict], loose: list[dict], chance: dict[str, float], least: float) -> list[tuple]:
    """All spans (kind, start, end, score) by start: base ones, and candidates that fit between.

    The likelier candidate goes first, then the earlier and the lower kind.
    """
    # disjoint stretches in order, so that only two neighbours can overlap a candidate
    taken: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in base):
        if taken and start < taken[-1][1]:
            taken[-1] = taken[-1][0], max(end, taken[-1][1])
        else:
            taken.append((start, end))
    known = {(s["kind"], s["start"], s["end"]) for s in base}
    out = [(s["kind"], s["start"], s["end"], 1.0) for s in base]
    rated = sorted(
        (-chance[s["cell"]], s["start"], s["kind"], s["end"])
        for s in loose
        if chance[s["cell"]] >= least and (s["kind"], s["start"], s["end"]) not in known
    )
    for score, start, kind, end in rated:
        at = bisect_left(taken, (start, end))
        before = at == 0 or taken[at - 1][1] <= start
        if before and (at == len(taken) or end <= taken[at][0]):
            taken.insert(at, (start, end))
            out.append((kind, start, end, -score))
    return sorted(out, key=lambda s: (s[1], s[0]))


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
LOOSE = pa.struct([*SPAN, ("cell", pa.string())])
RATED = pa.struct([*SPAN, ("score", pa.float64())])
_SPAN, _LOOSE, _RATED = (
    f"array<struct<kind:int,start:int,end:int{more}>>" for more in ("", ",cell:string", ",score:double")
)


def _structs(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    names = [f.name for f in kind]
    return pa.array([[dict(zip(names, s)) for s in row] for row in rows], pa.list_(kind))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, loose) of every row: base spans, and candidates with their cells."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [spans_of(t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    _structs([b for b, _ in found], SPAN),
                    _structs([c for _, c in found], LOOSE),
                ],
                names=["doc_id", "base", "loose"],
            )

    return texts(docs).mapInArrow(find, f"doc_id long, base {_SPAN}, loose {_LOOSE}")


def find_personal_data(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, base, spans) of every row of ``docs``.

    ``base``: (kind, start, end) of the base patterns, ``spans``: all, with a score (1 for base
    spans); both by start, then kind; offsets in code points, kinds by number in ``KINDS``. A null
    text is like an empty one and has no spans. Repeated rows count each. ``least``: probability
    from which a candidate is added.
    """
    scanned = stored(scan(docs), "spans")
    cells = scanned.select(F.explode("loose.cell").alias("cell")).groupBy("cell")
    # a few thousand cells at most: kinds x votes x buckets
    table = {r.cell: r.n for r in cells.agg(F.count("*").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(learn(table))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            base, loose = part.column("base"), part.column("loose")
            spans = [
                choose(b, c, shared.value, least) for b, c in zip(base.to_pylist(), loose.to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), base, _structs(spans, RATED)], names=["doc_id", "base", "spans"]
            )

    return scanned.mapInArrow(add, f"doc_id long, base {_SPAN}, spans {_RATED}")


def as_text(spans: str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
