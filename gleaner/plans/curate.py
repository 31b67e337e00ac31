"""The whole run: chunks, evidence, prompts, generation, validation, storage."""
from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import Encoder, hashing_encoder
from gleaner.operators.generation import Generate, batch_stats, target_prompts
from gleaner.operators.prompts import rag_prompts, random_prompts
from gleaner.operators.provenance import rag_pairs, sampled_pairs
from gleaner.operators.retrieval import embed_chunks
from gleaner.plans.rounds import run_rounds
from gleaner.session import checkpoint_folder, checkpointed

MOST_PROMPTS = 3.5  # per pair wanted: the largest factor of a round


@dataclass
class RunSettings:
    project_id: str
    job_id: str
    domain: str
    target_pairs: int = 50
    question_types: list[str] = field(default_factory=lambda: ["factual", "reasoning"])
    difficulties: list[str] = field(default_factory=lambda: ["intermediate"])
    provider: str = "ollama"
    model: str = "llama3"
    temperature: float = 0.7
    multiplier: float = 2.0
    min_quality_score: float = 0.4
    use_evidence: bool = True
    chunk_limits: dict[str, int] = field(default_factory=dict)


@dataclass
class RunResult:
    pairs: DataFrame
    outcomes: DataFrame
    stats: DataFrame


def generate_dataset(
    chunks: DataFrame,
    terms: DataFrame,
    settings: RunSettings,
    generate: Generate,
    seeds: DataFrame | None = None,
    encoder: Encoder = hashing_encoder,
    folder: str | None = None,
) -> RunResult:
    """Rounds of generation over a chunk table until the target is met.

    Prompts are made for the largest factor a round may have; rounds take them
    in order, so later ones are asked only where earlier ones fell short. Give
    ``folder`` to go on where a lost run ended. ``chunks`` as made by :mod:`gleaner.operators.chunks`, ``terms(position,
    query)`` the topics, ``seeds(position, question)`` questions stored before.
    """
    wanted = target_prompts(settings.target_pairs, max(MOST_PROMPTS, settings.multiplier))
    shared = (settings.domain, settings.question_types, settings.difficulties, wanted)
    if settings.use_evidence:
        index = checkpointed(embed_chunks(chunks, encoder))
        prompts = rag_prompts(terms, index, *shared, encoder=encoder)
    else:
        prompts = random_prompts(chunks, *shared, limits=settings.chunk_limits)
    prompts = checkpointed(prompts)
    if folder is None:
        folder = f"{checkpoint_folder(chunks.sparkSession).rstrip('/')}/run-{uuid.uuid4().hex}"
    rounds = run_rounds(
        prompts, settings.target_pairs, generate, settings.model, folder, settings.temperature,
        settings.multiplier, settings.min_quality_score, seeds, encoder,
    )
    generated, outcomes = rounds.generated, rounds.outcomes.drop("round")
    store = rag_pairs if settings.use_evidence else sampled_pairs
    pairs = store(
        outcomes.filter("accepted"), prompts, settings.project_id, settings.job_id,
        settings.provider, settings.model,
    )
    return RunResult(pairs, outcomes, batch_stats(generated, outcomes))
