"""Prompts as column expressions, for providers that call a language model."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSTEM = "Answer in {language} from the numbered passages only. Bring together what they say; say so if they don't hold the answer."
CONCEPTS = 'List five to ten short lower-case noun phrases that name what this passage is about. Answer as JSON: {{"concepts": [...]}}\n\n{text}'
QUESTIONS = "Write {n} questions in {language} that this passage answers, one a line and nothing else.\n\n{text}"
ENTITIES = "List the named entities of this {language} text, one a line, as TEXT|TYPE.\n\n{text}"
#: How a passage and its source are laid out in a context.
CONTEXT_BLOCK = "--- Context {i} (source: {source}, pos: {pos}) ---\n{text}\n"
SOURCE_HEADER = "=== Source: {source} ==="


#: How the question follows its context.
QUESTION = "{context}\nQuestion: {question}\n\nAnswer:"


def answer_prompt(question: Column, context: Column, language: Column) -> Column:
    """The final prompt, as (system, user)."""
    return F.struct(render(SYSTEM, language=language).alias("system"), render(QUESTION, context=context, question=question).alias("user"))


def render(template: str, **values: Column) -> Column:
    """The template with {name} replaced by columns; doubled braces are single ones."""
    out = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if piece in ("{{", "}}"):
            out.append(F.lit(piece[0]))
        elif re.fullmatch(r"\{\w+\}", piece):
            out.append(F.coalesce(values[piece[1:-1]].cast("string"), F.lit("")))
        elif piece:
            out.append(F.lit(piece))
    return F.concat(*out)
