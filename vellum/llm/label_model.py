"""A generative model of voters: their accuracies and correlations give posterior labels.

Votes are 1, -1 or 0 (abstains). Given the label, a voter votes by its own law, found by
expectation-maximisation with a fixed share of positives; the laws lean on counts against known
labels where there are some (``known``), so that the label keeps its meaning. Abstaining is no
evidence: a voter of one language or subject says nothing about texts of others. Voters are not
independent: the correlation of each two, given the label, is estimated under the posterior, and a
vote's evidence is divided by the size of the company that votes beside it on the row, so that
voters who say the same count once together and each alone counts in full; both steps alternate.
"""

from __future__ import annotations

import numpy as np

VALUES = np.array([-1, 0, 1])
ROUNDS, STEPS = 3, 25
#: Correlations below the first are taken for noise; voters with raw ones above the second for twins.
LEAST_CORRELATION, TWINS = 0.2, 0.6
#: Weight of a known label beside the posterior of its own row.
KNOWN_WEIGHT = 1.0


def posteriors(votes: np.ndarray, positive: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's probability of label 1, the voters' laws [label, voter, vote] and their correlations.

    ``known`` holds the rows' labels where training has them; a row's own label is no evidence for
    the row, it counts in the laws alone. No rows give empty posteriors.
    """
    is_vote = (votes[:, :, None] == VALUES).astype(np.float64)
    prior = np.log([1 - positive, positive])
    base = 0.5 if known is None else 0.5 + KNOWN_WEIGHT * _counts(known.astype(np.float64), is_vote)
    p = np.clip(positive + 0.3 * np.sign(votes.sum(axis=1)), 0.01, 0.99) if known is None else np.clip(known.astype(np.float64), 0.01, 0.99)
    # voters that nearly always agree are company from the start, else the label would become theirs
    share = _shares(votes, _correlation(votes - votes.sum(axis=0) / max(len(votes), 1)), TWINS)
    for _ in range(ROUNDS):
        for _ in range(STEPS):
            law = _counts(p, is_vote) + base
            law /= law.sum(axis=2, keepdims=True)
            weight = np.log(law)
            weight[:, :, VALUES == 0] = 0
            evidence = np.einsum("nmv,ymv,nm->yn", is_vote, weight, share, optimize=True) + prior[:, None]
            p = 1 / (1 + np.exp(np.clip(evidence[0] - evidence[1], -60, 60)))
        mean = np.einsum("ymv,v->ym", law, VALUES)
        correlation = _correlation(votes - (1 - p)[:, None] * mean[0] - p[:, None] * mean[1])
        share = _shares(votes, correlation, LEAST_CORRELATION)
    return p, law, correlation


def _correlation(left: np.ndarray) -> np.ndarray:
    scale = np.sqrt((left**2).sum(axis=0) / max(len(left), 1)) + 1e-9
    return (left.T @ left) / max(len(left), 1) / np.outer(scale, scale)


def _shares(votes: np.ndarray, correlation: np.ndarray, least: float) -> np.ndarray:
    """Each vote's part of its evidence [row, voter]."""
    strong = np.where(np.abs(correlation) >= least, np.abs(correlation), 0)
    np.fill_diagonal(strong, 0)
    return 1 / (1 + (votes != 0) @ strong)


def _counts(p: np.ndarray, is_vote: np.ndarray) -> np.ndarray:
    return np.einsum("yn,nmv->ymv", np.stack([1 - p, p]), is_vote)
