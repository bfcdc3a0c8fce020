"""Prompt templates of the scoring and summary stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Prompts of the stages, word for word.
MATH_SYSTEM = (
    "You are a precise math solver. Use the provided hints to compute the answer. "
    "Do NOT show steps. Respond with only the final answer, ideally in LaTeX like \\boxed{...}."
)
MATH_USER = """Solve the problem using the hints below. Do not explain your steps.

[Problem]
{problem}

[Hints]
{hints}

Respond ONLY with the final answer (e.g., \\boxed{...}).
"""
GENERAL_SYSTEM = (
    "You are a precise problem solver. Read the problem and the provided hints. "
    "Use the hints only to decide the final answer. Do NOT show steps. "
    "Output the final answer wrapped in <ans>...</ans> and nothing else."
)
GENERAL_USER = """Solve the problem using ONLY the hints below.

[Problem]
{problem}

[Hints]
{hints}

Return exactly one line in the format:
<ans>...your final answer...</ans>
"""
SUMMARY_SYSTEM = (
    "You are a precise summarizer. Read the problem and the provided hints. "
    "Write ONE concise, self-contained summary (<=40 words) of the reasoning leading to the answer. "
    "Do NOT show equations or detailed steps. Output ONLY <summary>...</summary>."
)
SUMMARY_USER = """Summarize using ONLY the hints below.

[Problem]
{problem}

[Hints]
{hints}

Return exactly one line:
<summary>...your concise summary...</summary>
"""
SUMMARY_USER_ANSWER = """Summarize using ONLY the hints below.

[Problem]
{problem}

[Final Answer]
{answer}

[Hints]
{hints}

Return exactly one line:
<summary>...your concise summary...</summary>
"""
TUTOR_SYSTEM = (
    "You are a concise math tutor. Given a math Question, the model's Final Answer, "
    "and raw Reasoning Traces, produce a short, faithful explanation of how to solve it. "
    "Use the traces only to ensure correctness and include key ideas; "
    "do NOT quote or replicate the traces verbatim; "
    "avoid step-by-step derivations, hidden thoughts, or any XML tags."
)
TUTOR_USER = (
    "Question:\n{problem}\n\n"
    "Final Answer:\n{answer}\n\n"
    "Reasoning Traces (raw & possibly truncated):\n{hints}\n\n"
    "Now provide a concise explanation (about 2–6 sentences) that justifies the final answer "
    "and highlights the main steps and insights. Do not reproduce the traces verbatim."
)
ASSISTANT_SYSTEM = (
    "You are a concise assistant. Given a Question, its Final Answer, and raw Reasoning Traces, "
    "produce a short, faithful explanation as 3–5 bullet points. "
    "Use the traces only to ensure correctness and capture key insights; "
    "do NOT quote or replicate the traces verbatim, and avoid step-by-step derivations."
)
ASSISTANT_USER = (
    "Question:\n{problem}\n\n"
    "Final Answer:\n{answer}\n\n"
    "Reasoning Traces (raw; may be truncated):\n{hints}\n\n"
    "Now provide 3–5 bullet points highlighting the main ideas and a brief verification."
)
TEMPLATES = {
    "math": (MATH_SYSTEM, MATH_USER), "general": (GENERAL_SYSTEM, GENERAL_USER), "summary": (SUMMARY_SYSTEM, SUMMARY_USER),
    "tutor": (TUTOR_SYSTEM, TUTOR_USER), "assistant": (ASSISTANT_SYSTEM, ASSISTANT_USER),
}


def filled(template: str, **values: Column) -> Column:
    """The template with each {name} replaced; what a value holds is not looked into again."""
    parts, rest = [], template
    while rest:
        at = min((rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest) if any("{" + n + "}" in rest for n in values) else None
        if at is None:
            parts.append(F.lit(rest))
            break
        parts += [F.lit(rest[: at[0]]), F.coalesce(values[at[1]], F.lit(""))]
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*parts)


def chat_prompt(kind: str, problem: Column, hints: Column, answer: Column | None = None, show_answer: bool = False) -> Column:
    """System and user block and the cue, in the plain form that stands where a model has no chat template. show_answer: a summary prompt shows an answer
    that isn't blank."""
    system, user = TEMPLATES[kind]
    answer = F.lit("") if answer is None else answer
    block = filled(user, problem=problem, hints=hints, answer=answer)
    if kind == "summary" and show_answer:
        block = F.when(F.coalesce(strip(answer), F.lit("")) != "", filled(SUMMARY_USER_ANSWER, problem=problem, hints=hints, answer=answer)).otherwise(block)
    return F.concat(F.lit(f"[SYSTEM]\n{system}\n\n"), block, F.lit("\n\nAssistant:"))
