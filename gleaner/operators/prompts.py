"""Prompt plans: which evidence, question type and difficulty each prompt gets."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import Encoder, embed, hashing_encoder
from gleaner.operators.ranking import draw_cuts, seeded_draw, with_global_rank
from gleaner.operators.retrieval import (
    MIN_SCORE,
    POOL,
    diverse_top_k,
    evidence_lists,
    scored_hits,
    with_chunk_text,
)
from gleaner.session import checkpointed

TASKS = {
    "factual": "Ask for one important fact and answer it directly.",
    "reasoning": "Ask why or how something happens and explain the chain of causes.",
    "comparison": "Ask how two treatments, findings or conditions differ and contrast them.",
    "application": "Describe a practical situation and ask what should be done; give the steps.",
}

DIFFICULTIES = {
    "beginner": "beginner: plain language and basic ideas for students",
    "intermediate": "intermediate: usual terminology for general practitioners",
    "advanced": "advanced: specialist terminology and fine distinctions",
}

SHARED_RULES = (
    "The answer must stand alone and never mention a text, passage, study or other source.\n"
    "Difficulty is {difficulty}.\n"
    "Reply with two fields only:\nQuestion: ...\nAnswer: ..."
)

PLAIN_TEMPLATES = {
    kind: f'Write one question and answer about "{{domain}}". {task}\n'
    f"Use only this material:\n{{text}}\n\n{SHARED_RULES}"
    for kind, task in TASKS.items()
}

EVIDENCE_TEMPLATES = {
    kind: f'Write one question and answer about "{{domain}}". {task}\n'
    f"Use only this evidence; if it is not sufficient reply NOT FOUND:\n{{text}}\n\n{SHARED_RULES}"
    for kind, task in TASKS.items()
}

AVOID_HEADING = "\n\nThese questions exist already; ask something clearly different:\n"
RECENT = 15


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, key), F.lit(table[default]))


def fill_template(
    kind: Column, text: Column, domain: Column, difficulty: Column, evidence: bool = True
) -> Column:
    """Prompt text; unknown kinds read as factual, unknown levels as intermediate.

    The text goes in last, so braces inside it stay as they are.
    """
    prompt = _lookup(EVIDENCE_TEMPLATES if evidence else PLAIN_TEMPLATES, kind, "factual")
    prompt = F.replace(prompt, F.lit("{domain}"), domain)
    prompt = F.replace(
        prompt, F.lit("{difficulty}"), _lookup(DIFFICULTIES, difficulty, "intermediate")
    )
    return F.replace(prompt, F.lit("{text}"), text)


def evidence_block(chunks: Column) -> Column:
    """Evidence texts under source headings, without citation tags."""
    return F.array_join(
        F.transform(
            chunks,
            lambda c: F.concat(
                F.lit("--- Medical Source ("),
                F.coalesce(F.nullif(c["source_filename"], F.lit("")), F.lit("Medical Source")),
                F.lit(") ---\n"),
                c["content"],
            ),
        ),
        "\n\n",
    )


def rotated(values: Column, turn: Column) -> Column:
    """Array rotated left by ``turn`` modulo its size."""
    by = F.pmod(turn, F.greatest(F.size(values), F.lit(1))).cast("int")
    return F.concat(F.slice(values, by + 1, F.size(values)), F.slice(values, F.lit(1), by))


def cycled(options: list[str], index: Column) -> Column:
    choices = F.array(*[F.lit(o) for o in options])
    return F.element_at(choices, (index % len(options)).cast("int") + 1)


def recent_questions(questions: DataFrame, position: str, n: int = RECENT) -> list[str]:
    """The last ``n`` questions, oldest first (``n`` rows reach the driver)."""
    rows = questions.orderBy(F.desc(position)).limit(n).select("question").collect()
    return [r["question"] for r in reversed(rows)]


def avoid_suffix(existing: list[str]) -> str:
    recent = existing[-RECENT:]
    return AVOID_HEADING + "\n".join(f"  - {q}" for q in recent) if recent else ""


def rag_prompts(
    terms: DataFrame,
    chunks: DataFrame,
    domain: str,
    question_types: list[str],
    difficulties: list[str],
    target: int,
    existing: list[str] | None = None,
    top_k: int = 5,
    min_score: float = MIN_SCORE,
    encoder: Encoder = hashing_encoder,
) -> DataFrame:
    """Prompts from retrieved evidence, ``target`` at most.

    ``terms(position, query)`` with optional ``vec``. Each term gets an equal
    number of prompts; they cycle through three evidence sizes and rotate the
    evidence. Terms without evidence are skipped and use up no index.
    """
    if "vec" not in terms.columns:
        terms = terms.withColumn("vec", embed(F.col("query"), encoder))
    terms = checkpointed(terms)
    per_term = max(1, target // max(terms.count(), 1))
    variants = min(3, per_term)
    hits = checkpointed(scored_hits(terms, chunks, POOL * (top_k + variants - 1), min_score))
    picked = diverse_top_k(hits, top_k).withColumn("variant", F.lit(0))
    for v in range(1, variants):
        picked = picked.unionByName(
            diverse_top_k(hits, top_k + v).withColumn("variant", F.lit(v))
        )
    evidence = evidence_lists(with_chunk_text(picked, chunks), "variant")
    found = with_global_rank(
        terms.join(hits.select("query").distinct(), "query", "left_semi").select(
            "position", "query"
        ),
        F.col("position"),
        name="place",
    )
    plan = (
        found.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(per_term - 1))))
        .withColumn("prompt_index", F.col("place") * per_term + F.col("turn"))
        .filter(F.col("prompt_index") < target)
        .withColumn("variant", F.col("turn") % 3)
    )
    index = F.col("prompt_index")
    return (
        plan.join(evidence, ["query", "variant"])
        .withColumn("evidence", rotated(F.col("evidence"), F.col("turn")))
        .withColumn("question_type", cycled(question_types, index))
        .withColumn("difficulty", cycled(difficulties, index))
        .select(
            "prompt_index",
            F.concat(
                fill_template(
                    F.col("question_type"),
                    evidence_block(F.col("evidence")),
                    F.lit(domain),
                    F.col("difficulty"),
                ),
                F.lit(avoid_suffix(existing or [])),
            ).alias("prompt"),
            F.col("evidence")[0]["content"].alias("chunk_text"),
            F.col("evidence")[0]["chunk_id"].alias("primary_chunk_id"),
            F.col("evidence")[0]["source_filename"].alias("source_filename"),
            F.lit("rag_ollama").alias("source_type"),
            F.col("query").alias("query_term"),
            "question_type",
            "difficulty",
            "retrieval_scores",
            "citation_chunk_ids",
            "citations",
        )
    )


def balanced_sample(
    chunks: DataFrame, target: int, limits: dict[str, int] | None = None, seed: int = 42
) -> DataFrame:
    """Chunks drawn evenly per source type, leftovers filling free places.

    ``chunks(chunk_id, source_type, ...)``. The random order is a seeded hash,
    so a rerun draws the same rows. Adds ``prompt_index``. Counting finds how
    far each type's draws reach; only the sample itself is put in order.
    """
    keys = chunks.select(
        "chunk_id", "source_type", seeded_draw(seed, F.col("chunk_id")).alias("draw")
    )
    sizes = {r[0]: r[1] for r in keys.groupBy("source_type").count().collect()}  # source types are few
    caps = {kind: n for kind, n in (limits or {}).items() if n > 0}
    share = target // max(len(sizes), 1)
    places = [(kind, "share", min(share, caps.get(kind, share))) for kind in sizes]
    places += [(kind, "limit", n) for kind, n in caps.items() if kind in sizes]
    cuts = draw_cuts(keys, places, "source_type", "draw")

    def before(name: str) -> Column:
        """Rows ahead of their type's cut, all of a type without one."""
        ahead = F.lit(True)
        for kind in sizes:
            if (kind, name) in cuts:
                other = ~F.col("source_type").eqNullSafe(F.lit(kind))
                ahead = ahead & (other | (F.col("draw") < cuts[kind, name][0]))
        return ahead

    taken = keys.filter(before("share")).select("chunk_id")
    free = target - sum(cuts[k, "share"][1] if (k, "share") in cuts else n for k, n in sizes.items())
    spare = keys.filter(before("limit") & ~before("share")).select(
        "chunk_id", F.lit(0).alias("all"), seeded_draw(seed + 1, F.col("chunk_id")).alias("draw")
    )
    last = draw_cuts(spare, [(0, "free", free)], "all", "draw")
    if last:
        spare = spare.filter(F.col("draw") < last[0, "free"][0])
    chosen = with_global_rank(
        taken.unionByName(spare.select("chunk_id")),
        seeded_draw(seed + 2, F.col("chunk_id")), F.col("chunk_id"), name="prompt_index",
    )
    return chunks.join(chosen, "chunk_id")


def random_prompts(
    chunks: DataFrame,
    domain: str,
    question_types: list[str],
    difficulties: list[str],
    target: int,
    existing: list[str] | None = None,
    limits: dict[str, int] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Prompts from sampled chunks, used when retrieval is off."""
    index = F.col("prompt_index")
    return (
        balanced_sample(chunks, target, limits, seed)
        .withColumn("question_type", cycled(question_types, index))
        .withColumn("difficulty", cycled(difficulties, index))
        .select(
            "prompt_index",
            "chunk_id",
            F.concat(
                fill_template(
                    F.col("question_type"),
                    F.col("content"),
                    F.lit(domain),
                    F.col("difficulty"),
                    evidence=False,
                ),
                F.lit(avoid_suffix(existing or [])),
            ).alias("prompt"),
            F.col("content").alias("chunk_text"),
            "source_type",
            "source_filename",
            "question_type",
            "difficulty",
        )
    )
