"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_scores, words

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
BASE = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}
#: Further counts that only the rules use.
EXTRA = {"word_bytes": "long", "n_upper": "long", "n_letters": "long", "n_distinct": "long", "n_bare": "long", "n_exclaim": "long", "n_lines": "long"}


def _word_ids(ws: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    seen: dict[bytes, int] = {}
    ids = np.fromiter([seen.setdefault(w, len(seen)) for w in ws], np.int64, len(ws))
    return ids, seen


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words covered by a window of three words that occurs twice or more; the first occurrence counts too."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct > 2_000_000:  # the third factor would overflow 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
        width = int(pairs.max()) + 1
        keys = ids[2:] * width + pairs[:-1]
    else:
        keys = pairs[:-1] * distinct + ids[2:]
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    hit = np.zeros(len(keys), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(keys)] |= hit
    return int(covered.sum())


def text_counts(text: str | None) -> dict[str, int]:
    """Whole-text counts. Null and empty texts have none of anything."""
    if not text:
        return dict.fromkeys([*BASE, *EXTRA], 0)
    raw = text.encode("utf-8", "surrogatepass")
    ws = raw.split()
    spaces = len(raw) - sum(map(len, ws))
    ids, numbers = _word_ids(ws)
    distinct = len(numbers)
    bare = [n for c in SYMBOLS if (n := numbers.get(bytes([c]))) is not None]
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    return {
        "n_words": len(ws),
        "word_chars": len(text) - spaces,
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(ids, distinct),
        "word_bytes": len(raw) - spaces,
        "n_upper": len(raw) - len(raw.translate(None, _CAPITALS)),
        "n_letters": len(raw) - len(raw.translate(None, _LETTERS)),
        "n_distinct": distinct,
        "n_bare": int(np.isin(ids, bare).sum()) if bare else 0,
        "n_exclaim": raw.count(b"!!"),
        "n_lines": len(lines),
    }


_CAPITALS = bytes(range(65, 91))
#: ASCII letters and digits and all bytes of other characters.
_LETTERS = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


@dataclass(frozen=True)
class Rule:
    """A ratio beyond ``bad`` votes bad, one short of ``good`` votes good; a rule abstains otherwise.

    With ``reverse``, low ratios are bad. Most rules know one defect only and never vote good.
    """

    name: str
    top: str
    bottom: str
    bad: float
    good: float | None = None
    reverse: bool = False

    def vote(self):
        x = F.when(F.col(self.bottom) > 0, F.col(self.top) / F.col(self.bottom))
        sign = -1 if self.reverse else 1
        vote = F.when(sign * x > sign * self.bad, -1)
        if self.good is not None:
            vote = vote.when(sign * x < sign * self.good, 1)
        return vote.otherwise(0)


RULES = (
    Rule("symbols", "n_symbols", "n_words", 0.10),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.50),
    Rule("repeats", "n_repeat_words", "n_words", 0.40, 0.15),
    Rule("capitals", "n_upper", "n_letters", 0.30),
    Rule("letters", "n_letters", "word_bytes", 0.90, 0.94, True),
    Rule("bare_symbols", "n_bare", "n_words", 0.15),
    Rule("variety", "n_distinct", "n_words", 0.08, None, True),
    Rule("shouting", "n_exclaim", "n_words", 0.10),
    Rule("long_words", "word_chars", "n_words", 20.0),
)


#: Documents that the belief about a rule before any votes weighs as much as.
BELIEF = 20.0


def belief(rule: Rule) -> np.ndarray:
    """P(bad vote, abstention, good vote) in good and in bad documents, as held before any votes.

    A bad vote is rare in good documents; a rule that knows one defect only sees it in a fifth of the bad ones.
    """
    if rule.good is None:
        return np.array([[0.005, 0.995, 0.0], [0.2, 0.8, 0.0]])
    return np.array([[0.005, 0.295, 0.7], [0.2, 0.5, 0.3]])


@dataclass(frozen=True)
class LabelModel:
    """P(good) before votes, and for each rule what its bad vote, abstention and good vote add to the log odds of good."""

    prior: float
    adds: tuple[tuple[float, float, float], ...]

    def posterior(self, votes: list):
        """The posterior of good as a column of the vote columns."""
        odds = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for vote, (down, none, up) in zip(votes, self.adds, strict=True):
            odds = odds + F.when(vote > 0, up).when(vote < 0, down).otherwise(none)
        return 1 / (1 + F.exp(-odds))


def starts(votes: np.ndarray) -> list[np.ndarray]:
    """What EM may begin with, as P(good) of each pattern: the majority of its votes, any bad vote, several, each rule alone."""
    bad, good = (votes == -1).sum(1), (votes == 1).sum(1)
    each = [votes[:, i] == -1 for i in range(votes.shape[1])]
    return [np.where(x, 0.1, 0.9) for x in (bad > good, bad > 0, bad > 1, *each)]


def _em(seen: np.ndarray, counts: np.ndarray, beliefs: np.ndarray, good: np.ndarray, rounds: int) -> tuple[float, LabelModel]:
    """The model that EM reaches from P(good) of each pattern, and its log likelihood with that of its beliefs."""
    for _ in range(rounds):
        weight = np.stack([good * counts, (1 - good) * counts])
        prior = (weight[0].sum() + 1) / (counts.sum() + 2)
        share = np.einsum("cp,prs->rcs", weight, seen) + BELIEF * beliefs
        share /= share.sum(2, keepdims=True)
        possible = share.min(1) > 0
        adds = np.log(np.where(possible, share[:, 0], 1) / np.where(possible, share[:, 1], 1))
        adds[:, 0] = np.minimum(adds[:, 0], 0)
        adds[:, 2] = np.maximum(adds[:, 2], 0)
        odds = np.log(prior / (1 - prior)) + np.einsum("prs,rs->p", seen, adds)
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        change = np.abs(new - good).max(initial=0.0)
        good = new
        if change < 1e-9:
            break
    logs = np.log(np.where(share > 0, share, 1))
    by_class = np.einsum("prs,rcs->cp", seen, logs) + np.log([prior, 1 - prior])[:, None]
    fits = float(counts @ np.logaddexp(*by_class)) + BELIEF * float((beliefs * logs).sum())
    return fits, LabelModel(float(prior), tuple(tuple(map(float, a)) for a in adds))


def fit_em(votes: np.ndarray, counts: np.ndarray, beliefs: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and how many documents have each.

    Estimated are the share of good documents and, for good and for bad ones, how often each rule votes bad,
    abstains and votes good (``beliefs``: rules x 2 x 3, BELIEF documents strong). So a rule that never votes good
    has accuracies like any other: its bad votes and its abstentions are each set against the two classes. EM runs from
    several ``starts``; the model that explains the votes best is taken, the first among equals. So a rule that others
    do not bear out weighs little, and its lone bad vote does not decide. Rules are no worse than chance: a bad vote never
    speaks for a document, a good one never against it. Without documents the prior is one half and the beliefs decide.
    """
    seen = np.stack([votes == -1, votes == 0, votes == 1], 2).astype(float)  # patterns, rules, outcomes
    tried = [_em(seen, counts, beliefs, good, rounds) for good in starts(votes)]
    best = max(fits for fits, _ in tried)
    return next(model for fits, model in tried if fits >= best - 1e-6 * abs(best))


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts of each whole text."""

    def fn(texts: list[str | None]) -> dict[str, list]:
        got = [text_counts(t) for t in texts]
        return {c: [g[c] for g in got] for c in [*BASE, *EXTRA]}

    return with_scores(df, text, fn, {**BASE, **EXTRA})


def fit(features: DataFrame, rules: tuple[Rule, ...] = RULES) -> LabelModel:
    """Count the vote patterns of all documents on Spark (at most 3 to the number of rules) and run EM on them."""
    named = features.filter(F.col("n_words") > 0).select(*[r.vote().alias(f"v{i}") for i, r in enumerate(rules)])
    rows = named.groupBy(*named.columns).count().collect()
    rows.sort(key=tuple)
    votes = np.array([r[:-1] for r in rows], int).reshape(-1, len(rules))
    return fit_em(votes, np.array([r[-1] for r in rows], float), np.stack([belief(r) for r in rules]))


def judge(features: DataFrame, model: LabelModel, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """``features`` with base_failed, p_good (null for a text without words) and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated windows. kept is false if
    base_failed, and else whether p_good reaches ``threshold``.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    p = F.when(F.col("n_words") > 0, model.posterior([r.vote() for r in rules]))
    out = features.withColumn("base_failed", base).withColumn("p_good", p)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("p_good"), F.lit(0.0)) >= threshold))


def quality_rules(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Each row of ``df`` with its counts, p_good, base_failed and kept.

    Two passes over the texts, none of which shuffles them: one counts vote patterns, one judges.
    Null or empty texts: counts 0, p_good null, base_failed. Rows are judged one by one, so repeated rows
    and ties get the same verdict; an empty frame gives an empty frame. Columns of ``df`` named like a
    result are replaced.
    """
    features = text_features(df, text)
    return judge(features, fit(features.select(*BASE, *EXTRA)), threshold=threshold)
