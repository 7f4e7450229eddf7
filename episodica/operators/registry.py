"""The analyzers by name, and reports as byte-stable text."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.profiles import Profile, profile
from . import contrast, errors, ngrams, stalls


@dataclass
class Corpus:
    """What analyzers read: steps (idx, action, obs and the detectors' columns) and episodes."""

    domain: str
    composition: str
    merkle_root: str
    steps: DataFrame
    episodes: DataFrame
    pass_rates: dict = field(default_factory=dict)

    @property
    def profile(self) -> Profile:
        return profile(self.domain)


@dataclass
class Report:
    name: str
    version: str
    merkle_root: str
    rows: DataFrame
    evidence: DataFrame | None = None
    status: str = "ok"


def error_frequency(corpus: Corpus, config: dict) -> Report:
    events = errors.error_events(corpus.steps, config.get("taxonomy", errors.TAXONOMY), corpus.profile)
    return Report("error_frequency", "1.0", corpus.merkle_root, errors.error_frequency(events, corpus.episodes), errors.error_evidence(events, config.get("max_evidence", errors.EVIDENCE)).orderBy("error_type", "rank"))


def ngram(corpus: Corpus, config: dict) -> Report:
    rows = ngrams.ngram_report(corpus.steps, corpus.episodes, config.get("n_values", ngrams.N_VALUES), config.get("min_count", ngrams.MIN_COUNT), config.get("max_per_trajectory", ngrams.PER_EPISODE))
    return Report("ngrams", "1.0", corpus.merkle_root, rows)


def stall(corpus: Corpus, config: dict) -> Report:
    rows = stalls.stall_report(corpus.steps, corpus.episodes, config.get("m_min", stalls.LEAST_REPEATS), config.get("cycle_max", stalls.LONGEST_PERIOD), corpus.profile.whitelist)
    rate = stalls.stall_rate(rows).first()["stall_rate"]
    return Report("stalls", "1.0", corpus.merkle_root, rows.orderBy("trajectory_id"), status=f"stall_rate={rate:.6f}")


def win_loss(corpus: Corpus, config: dict) -> Report:
    """Default predicates are of the labels; `stalled` is found with default settings."""
    predicates = config.get("predicates")
    episodes = corpus.episodes
    if predicates is None:
        found = stalls.stall_report(corpus.steps, episodes, whitelist=corpus.profile.whitelist).select("trajectory_id", "stalled")
        episodes = episodes.drop("stalled").join(found, "trajectory_id", "left")
        types = [r[0] for r in episodes.select(F.explode("error_types")).distinct().collect()] if "error_types" in episodes.columns else []
        predicates = contrast.default_predicates(types)
    paired = config.get("paired", corpus.composition == "paired")
    run = contrast.paired_contrast if paired else contrast.unpaired_contrast
    status = contrast.contrast_header(episodes, paired).first()["status"]
    return Report("win_loss_contrast", "1.0", corpus.merkle_root, run(episodes, predicates, config.get("q", 0.10)), status=status)


ANALYZERS: dict[str, Callable[[Corpus, dict], Report]] = {"error_frequency": error_frequency, "ngrams": ngram, "stalls": stall, "win_loss_contrast": win_loss}


def registered_analyzers() -> list[str]:
    return sorted(ANALYZERS)


def run_all(corpus: Corpus, config: dict[str, dict] | None = None) -> list[Report]:
    return [ANALYZERS[name](corpus, (config or {}).get(name, {})) for name in registered_analyzers()]


def _plain(x):
    if isinstance(x, Row):
        return {k: _plain(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in sorted(x.items())}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return float(x) if isinstance(x, Decimal) else x


def serialize(report: Report) -> str:
    """The ordered rows as text; reports are small."""
    held = {"name": report.name, "version": report.version, "corpus_merkle_root": report.merkle_root, "status": report.status, "rows": [_plain(r) for r in report.rows.collect()]}
    if report.evidence is not None:
        held["evidence"] = [_plain(r) for r in report.evidence.collect()]
    return json.dumps(held, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def assert_byte_stable(corpus: Corpus, config: dict[str, dict] | None = None) -> None:
    """Reports must not depend on partitioning or row order."""
    spark = corpus.steps.sparkSession
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = [serialize(r) for r in run_all(corpus, config)]
    mixed = Corpus(corpus.domain, corpus.composition, corpus.merkle_root, corpus.steps.repartition(5).orderBy(F.desc("idx")), corpus.episodes.repartition(3))
    spark.conf.set("spark.sql.shuffle.partitions", str(int(before) + 3))
    try:
        again = [serialize(r) for r in run_all(mixed, config)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for name, a, b in zip(registered_analyzers(), first, again):
        if a != b:
            raise AssertionError(f"{name} isn't byte-stable:\n{a}\n{b}")
