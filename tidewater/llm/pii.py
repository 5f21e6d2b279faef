"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans.  The model looks at runs of digit groups, at
spelt-out addresses and at long tokens that the patterns leave: whole-span
features score each candidate segment of at most MAX_UNITS units, transitions
score a segment's label after that of the segment beside it, and dynamic
programming over ends and last labels chooses boundaries and types jointly.
Text outside such runs has one labelling, so leaving it out changes no result.
The model is trained here, on runs made by rule from a fixed seed with up to
three entities each, by the exact gradient of its log-likelihood.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import map_text, quoted

#: The kinds of the patterns, and after them the one that only the model finds: keys and other credentials.
KINDS = ("email", "ip", "card", "phone", "secret")
MAX_UNITS = 18
LABELS = ("email", "card", "phone", "secret")  # an address of numbers is an ip by pattern alone

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Runs of digit groups with short separators.
_RUN = re.compile(r"\(?[0-9]+(?:[ .()/-]{1,2}[0-9]+)+")
#: From the at sign on; up to 64 signs of _LOCAL and a space may stand before it.
_SPELT = re.compile(r"(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}){1,4}")
#: The sign and the country of a phone number.
_LEAD = re.compile(r"\+(?:[0-9]{1,3}[ .-]{1,2})?$")
#: Long tokens of letters and digits, with what may name them before.
_TOKEN = r"(?=[A-Za-z_+/=-]*[0-9])(?=[0-9_+/=-]*[A-Za-z])(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}={0,2}"
_NAMED = re.compile(r"(?:[A-Za-z_]{2,20}[ \t]{0,2}[:=][ \t]{0,2}[\"']?)?" + _TOKEN)
_KEY = re.compile(r"(?i)key|token|secret|pass|auth|cred|bearer|pwd")
_UNIT = re.compile(_TOKEN + r"|[0-9]+|\((?:at|dot)\)|\[(?:at|dot)\]|\b(?:at|dot)\b|[A-Za-z]+|[^0-9A-Za-z]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Sorted (start, kind number, end), leftmost and non-overlapping within a kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((start, 0, done))
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    if (first := _DIGIT.search(text)) is not None:
        from_ = first.start()
        for m in _IP.finditer(text, from_):
            if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text, from_):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text, max(0, from_ - 1)):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _is_token(unit: str) -> bool:
    return len(unit) >= 16 and not unit.isdigit() and not unit.isalpha()


def token_features(unit: str, before: list[str]) -> list[str]:
    """Features of a long token and of what stands before it."""
    n = len(unit)
    counts = [unit.count(c) for c in set(unit)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    digits = sum(c.isdigit() for c in unit)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(unit, unit[1:]))
    return [
        f"size:{min(n // 8, 8)}",
        f"entropy:{int(2 * entropy)}",
        f"hex:{all(c in '0123456789abcdef' for c in unit.lower())}:{n % 8 == 0}",
        f"cases:{unit != unit.upper()}:{unit != unit.lower()}",
        f"digits:{8 * digits // n}",
        f"turns:{min(8, 16 * turns // n)}",
        f"parts:{min(3, sum(unit.count(c) for c in '-_/'))}",
        f"named:{any(_KEY.search(u) for u in before[-8:])}:{any(u in ':=' for u in before[-4:])}",
        "token",
    ]


def span_features(units: list[str], i: int, j: int) -> list[str]:
    """Features of the whole segment units[i:j]."""
    own = units[i:j]
    if any(map(_is_token, own)):
        return token_features(own[0], units[:i]) if len(own) == 1 else ["token", f"longer:{min(len(own), 4)}"]
    groups = [u for u in own if u.isdigit()]
    digits = "".join(groups)
    seps = {u for u in own if not u.isalnum()}
    n = len(digits)
    return [
        f"digits:{n if n <= 19 else 20}",
        f"groups:{min(len(groups), 6)}",
        "sizes:" + ".".join(str(min(len(g), 7)) for g in groups[:5]),
        f"luhn:{13 <= n <= 19 and luhn(digits)}",
        "seps:" + "".join(sorted(seps))[:4],
        f"parens:{own[0] == '('}:{'(' in seps}:{')' in seps}",
        f"spelt:{sum('at' in u for u in own if not u.isdigit())}:{sum('dot' in u for u in own if not u.isdigit()) > 0}",
        f"ends:{own[0].isalnum() or own[0] == '('}:{own[-1].isalnum()}",
        f"edge:{i == 0}:{j == len(units)}",
    ]


#: The state of a run that has no segment right before: nothing yet, or other words since.
_APART = len(LABELS)


def _ending(units: list[str], j: int, weights: dict):
    """(i, label, score, features) of the candidate segments that end at j."""
    if _is_token(units[j - 1]):
        starts = [j - 1]
    elif units[j - 1].isalnum():
        starts = [i for i in range(max(0, j - MAX_UNITS), j - 1) if units[i].isalnum() or units[i] == "("]
    else:
        starts = []
    for i in starts:
        features = span_features(units, i, j)
        for k in range(len(LABELS)):
            yield i, k, sum(weights.get((k, f), 0.0) for f in features) + weights.get((k, ""), -2.0), features


def _after(state: int, unit: str) -> int:
    """The state after a unit that stands alone: separators keep segments beside each other."""
    return state if not unit.isalnum() and not _is_token(unit) else _APART


def decode(units: list[str], weights: dict) -> list[tuple[int, int, int]]:
    """The best segmentation: labelled segments (i, j, label); other units stand alone and score nothing.

    Scores are worked out where they are used, so a run of any length holds only
    the best way to each end and last label.
    """
    n = len(units)
    best: list[dict[int, tuple[float, int, int | None, int]]] = [{_APART: (0.0, 0, None, _APART)}] + [{} for _ in range(n)]
    for j in range(1, n + 1):
        now = best[j]
        for s, (v, *_) in best[j - 1].items():
            t = _after(s, units[j - 1])
            if t not in now or v > now[t][0]:
                now[t] = (v, j - 1, None, s)
        for i, k, score, _ in _ending(units, j, weights):
            for s, (v, *_) in best[i].items():
                w = v + score + weights.get(("after", s, k), 0.0)
                if k not in now or w > now[k][0]:
                    now[k] = (w, i, k, s)
    out, j, s = [], n, max(best[n], key=lambda s: best[n][s][0])
    while j:
        _, i, k, before = best[j][s]
        if k is not None:
            out.append((i, j, k))
        j, s = i, before
    return out[::-1]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _learn(units: list[str], truth: list[tuple[int, int, int]], weights: dict, rate: float) -> None:
    """One step up the gradient: features and transitions of the true segments less those expected by forward-backward."""
    n, states = len(units), range(len(LABELS) + 1)
    ending = [[]] + [list(_ending(units, j, weights)) for j in range(1, n + 1)]
    link = lambda s, k: weights.get(("after", s, k), 0.0)
    ahead: list[dict[int, float]] = [{_APART: 0.0}]
    for j in range(1, n + 1):
        ways: dict[int, list[float]] = {}
        for s, v in ahead[j - 1].items():
            ways.setdefault(_after(s, units[j - 1]), []).append(v)
        for i, k, score, _ in ending[j]:
            ways.setdefault(k, []).extend(v + score + link(s, k) for s, v in ahead[i].items())
        ahead.append({s: _log_sum(v) for s, v in ways.items()})
    behind: list[dict[int, list[float]]] = [{s: [] for s in states} for _ in range(n)] + [{s: [0.0] for s in states}]
    for j in range(n, 0, -1):
        done = {s: _log_sum(v) for s, v in behind[j].items() if v}
        behind[j] = done
        for s in states:
            if (t := _after(s, units[j - 1])) in done:
                behind[j - 1][s].append(done[t])
        for i, k, score, _ in ending[j]:
            if k in done:
                for s in states:
                    behind[i][s].append(done[k] + score + link(s, k))
    whole = _log_sum(list(ahead[n].values()))
    true, last, at = {}, _APART, 0
    for i, j, k in truth:
        for u in units[at:i]:
            last = _after(last, u)
        true[i, j, k], last, at = last, k, j
    for j in range(1, n + 1):
        for i, k, score, features in ending[j]:
            p = 0.0
            for s, v in ahead[i].items():
                own = math.exp(v + score + link(s, k) + behind[j][k] - whole)
                p += own
                step = rate * ((true.get((i, j, k)) == s) - own)
                if abs(step) > 1e-6:
                    weights["after", s, k] = link(s, k) + step
            step = rate * (((i, j, k) in true) - p)
            if abs(step) > 1e-6:
                for f in [*features, ""]:
                    weights[k, f] = weights.get((k, f), -2.0 if not f else 0.0) + step


def _made_entity(r: random.Random) -> tuple[str, str, int | None]:
    """What stands before, the text, and its label or None."""
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    sep, kind = r.choice("-. "), r.randrange(11)
    if kind == 0:
        return "", f"({num(3)}) {num(3)}{r.choice('- ')}{num(4)}", 2
    if kind == 1:
        return "", f"{num(3)}{sep}{num(3)}{sep}{num(4)}", 2
    if kind == 2:
        body = num(15)
        d = body + next(c for c in "0123456789" if luhn(body + c))
        return "", r.choice("./- ").join(d[k : k + 4] for k in range(0, 16, 4)), 1
    if kind == 3:
        name = "".join(r.choice("abcdefgh") for _ in range(5))
        a, d = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("at", "dot")])
        return "", f"{name} {a} {name[::-1]} {d} {r.choice(['com', 'org', 'net'])}", 0
    if kind == 4:
        return "", f"{num(4)}-{num(2)}-{num(2)}", None
    if kind == 5:
        return "", r.choice([f"{num(1)}.{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(3)} {num(3)}", f"{num(4)}-{num(4)}"]), None
    if kind == 6:
        return "", f"{num(r.randrange(1, 4))}{sep}{num(r.randrange(1, 7))}{sep}{num(r.randrange(1, 3))}", None
    if kind == 7:
        return "", sep.join(num(r.randrange(1, 6)) for _ in range(r.randrange(5, 9))), None
    if kind == 8:  # credentials, some of them without a name
        signs = r.choice(["0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"])
        token = "a1" + "".join(r.choice(signs) for _ in range(r.choice([22, 30, 38, 46, 62])))
        named = r.choice(["", "token = \"", "api_key: ", "secret=", "password = '", "auth: "])
        return named, token, 3 if named or len(token) >= 32 else None
    if kind == 9:  # long words that are none
        word = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
        return r.choice(["", "id: ", "file = "]), r.choice([f"{word(6)}-{word(7)}-{num(4)}", f"{word(5)}/{num(4)}/{num(2)}/{word(9)}", f"{word(14)}{num(2)}", f"{num(4)}-{num(2)}-{num(2)}T{num(6)}Z", f"chapter_{word(8)}_{num(1)}"]), None
    return "", num(r.randrange(1, 7)), None


def _made_runs(n: int, seed: int):
    """Labelled runs made by rule: units and the true segments, up to three entities side by side."""
    r = random.Random(seed)
    for _ in range(n):
        units: list[str] = []
        truth = []
        for k in range(r.choice([1, 1, 1, 2, 2, 3])):
            before, text, label = _made_entity(r)
            units += _UNIT.findall((r.choice([" ", " ", ", ", "  "]) if k else "") + before)
            own = _UNIT.findall(text)
            if label is not None:
                truth.append((len(units), len(units) + len(own), label))
            units += own
        yield units, truth


@lru_cache(maxsize=1)
def trained(runs: int = 1200, rounds: int = 4, seed: int = 11) -> dict:
    """The model's weights; the same on every call."""
    weights: dict = {}
    made = list(_made_runs(runs, seed))
    for k in range(rounds):
        for units, truth in made:
            _learn(units, truth, weights, 0.3 / (1 + k))
    return weights


def _gaps(n: int, base: list[tuple[int, int, int]]):
    """The parts of a text of n code points that the sorted base spans leave."""
    at = 0
    for s, _, e in base:
        if s > at:
            yield at, s
        at = max(at, e)
    if at < n:
        yield at, n


def _spelt(text: str, a: int, b: int):
    """(start, end) of the spelt-out addresses in text[a:b]; looks to the left of at signs, so plain words cost little."""
    at = a
    while m := _SPELT.search(text, at, b):
        end = m.start()
        if end > a and text[end - 1] == " ":
            end -= 1
        start = end
        while start > a and end - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        if start < end:
            yield start, m.end()
            a = at = m.end()
        else:
            at = m.start() + 1


def model_spans(text: str, base: list[tuple[int, int, int]], weights: dict) -> list[tuple[int, int, int]]:
    """Further spans of the model, none of which overlaps a base span; what stands beside one is decoded by itself."""
    out = []
    digits = _DIGIT.search(text) is not None
    tokens = digits and any(len(w) >= 16 for w in text.split())
    spelt = "(dot)" in text or "[dot]" in text or " dot " in text  # every spelt-out address has one
    for a, b in _gaps(len(text), base) if digits or spelt else ():
        runs = [m.span() for m in _NAMED.finditer(text, a, b)] if tokens else []
        runs += [m.span() for m in _RUN.finditer(text, a, b)] if digits else []
        if spelt:
            runs += _spelt(text, a, b)
        own = []
        for first, last in runs:
            units = [(u[0], u.start(), u.end()) for u in _UNIT.finditer(text, first, last)]
            for i, j, k in decode([u[0] for u in units], weights):
                start, kind, end = units[i][1], KINDS.index(LABELS[k]), units[j - 1][2]
                if kind == 3 and (lead := _LEAD.search(text, max(a, start - 6), start)):
                    start = lead.start()
                own.append((start, kind, end))
        # where spans overlap the first found counts, so a span is held against its neighbours among those kept
        starts, kept = [], []
        for span in own:
            p = bisect_right(starts, span[0])
            if (p == 0 or kept[p - 1][2] <= span[0]) and (p == len(kept) or span[2] <= kept[p][0]):
                starts.insert(p, span[0])
                kept.insert(p, span)
        out += kept
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_pii(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds base_spans and spans (kind, start, end in code points, end exclusive), by start and then kind.

    An empty table gives no rows.  Null and empty texts have none.  Rows are handled one by one, so repeated
    rows and null ids need no rule.  Columns of the same name in docs are replaced.
    """
    weights = trained()
    fields = [T.StructField("base_spans", _SPANS), T.StructField("spans", _SPANS)]
    named = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(spans)]

    def make():
        def work(texts):
            base, full = [], []
            for data in texts:
                text = data.decode("utf-8") if data else ""
                own = base_spans(text)
                base.append(named(own))
                full.append(named(own + model_spans(text, own, weights)))
            return [pa.array(base, _ARROW_SPANS), pa.array(full, _ARROW_SPANS)]

        return work

    return map_text(docs, make, fields, text_col, carry)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each maximal group of overlapping spans replaced by its first kind in brackets."""
    out, at, end = [], 0, 0
    for s, e, kind in spans:
        if s >= end:
            out += [text[at:s], f"[{kind.upper()}]"]
        end = at = max(end, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows of docs with the personal data in their texts replaced by its kind; a null text stays null."""
    weights = trained()
    field = [T.StructField("__redacted", T.StringType())]

    def make():
        def work(texts):
            out = []
            for data in texts:
                text = data.decode("utf-8") if data is not None else None
                if text:
                    base = base_spans(text)
                    text = redacted(text, [(s, e, KINDS[k]) for s, k, e in sorted(base + model_spans(text, base, weights))])
                out.append(text)
            return [pa.array(out, pa.string())]

        return work

    out = map_text(docs, make, field, text_col, [c for c in docs.columns if c != text_col])
    return out.select(*[(F.col("__redacted").alias(c) if c == text_col else quoted(c)) for c in docs.columns])


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Per document the counts of base spans, a digest of them, and all spans."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), carry=["doc_id"])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(of_kind, KINDS[:4]), F.sha2(joined("base_spans").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
