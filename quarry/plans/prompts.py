"""Prompts: templates are rendered on the driver once, rows only add their text by concatenation."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.schema import Example, TemplateError

_VARIABLE = re.compile(r"\{([^{}]*)\}")

TASK = "You extract information from texts with care and copy values exactly as they are written."
FORMAT = {
    "json": "Answer with valid JSON of the same structure as in the examples.",
    "yaml": "Answer with valid YAML of the same structure as in the examples.",
}
FENCED = " Put it between ```{format} and ```."
REASONING = "\n\nWork in steps:\n1. Read the whole text\n2. Find what is asked for\n3. Give it in the form of the examples"
EXAMPLES, INPUT, OUTPUT = "\n\nExamples:\n", "\n\nNow take the values from this text:\n\nInput: ", {"json": "\n\nOutput (JSON):", "yaml": "\n\nOutput (YAML):"}
MORE = "\n\nLook for further values that were missed so far, also related ones and other forms of the same information."


def variables(template: str) -> list[str]:
    """The template's variables in order of first use."""
    return list(dict.fromkeys(_pieces(template)[1::2]))


def _pieces(template: str) -> list[str]:
    """Texts and variable names in turn."""
    parts = _VARIABLE.split(template)
    if any("{" in t for t in parts[::2]):
        raise TemplateError("Invalid syntax: a variable is not closed")
    return parts


def render(template: str, values: dict[str, str], strict: bool = False) -> str:
    """Values are not scanned again. A missing one is empty, or an error if strict."""
    out = _pieces(template)
    for k in range(1, len(out), 2):
        if strict and out[k] not in values:
            raise TemplateError(f"Missing variable: {out[k]}")
        out[k] = values.get(out[k], "")
    return "".join(out)


def validate(template: str, needed: tuple[str, ...] = ("task_description", "input_text")) -> None:
    missing = [n for n in needed if n not in variables(template)]
    if missing:
        raise TemplateError(f"Template lacks {', '.join(missing)}")


def format_examples(examples: list[Example], fmt: str = "json", most: int = 5) -> str:
    """Numbered examples; of values of one class the last is shown, classes in order."""
    out = []
    for i, x in enumerate(examples[:most], 1):
        values = dict(sorted({e.extraction_class: e.extraction_text for e in x.extractions}.items()))
        if fmt == "json":
            said = json.dumps(values, indent=2, ensure_ascii=False)
        else:
            said = "\n".join(f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in values.items())
        out.append(f"Example {i}:\nInput: {x.text}\nOutput:\n{said}\n")
    return EXAMPLES + "\n".join(out) if out else ""


@dataclass(frozen=True)
class PromptTemplate:
    description: str
    examples: tuple[Example, ...] = ()
    format: str = "json"
    max_examples: int = 5
    reasoning: bool = False
    fenced: bool = False
    schema_hint: str | None = None
    extra: dict[str, str] = field(default_factory=dict)
    template: str = "{task_description}\n\n{instruction}{format_instruction}{schema_hint}{additional_context}{examples}{reasoning}{input_header}{input_text}{output_header}\n"

    @classmethod
    def for_provider(cls, provider: str, description: str, examples: tuple[Example, ...], fmt: str = "json") -> PromptTemplate:
        """Chat providers take five examples; local and custom ones three, and are asked to reason."""
        made = cls(description, examples, fmt)
        return made if provider == "openai" else replace(made, max_examples=3, reasoning=True)

    def values(self) -> dict[str, str]:
        return {
            "task_description": self.description, "instruction": TASK + " ", "format_instruction": FORMAT[self.format] + (FENCED.replace("{format}", self.format) if self.fenced else ""), "schema_hint": f"\n{self.schema_hint}" if self.schema_hint else "",
            "examples": format_examples(list(self.examples), self.format, self.max_examples), "reasoning": REASONING if self.reasoning else "", "input_header": INPUT, "output_header": OUTPUT[self.format],
        } | self.extra

    def render(self, text: str, context: str | None = None) -> str:
        validate(self.template)
        more = f"\n\nAdditional Context: {context}\n" if context else ""
        return render(self.template, self.values() | {"input_text": text, "additional_context": more})

    def column(self, text: Column, context: Column | None = None) -> Column:
        """The prompt as one concatenation: all but the row's text and context is literal."""
        validate(self.template)
        more = F.lit("") if context is None else F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("\n\nAdditional Context: "), context, F.lit("\n"))).otherwise("")
        row, fixed = {"input_text": text, "additional_context": more}, self.values()
        out: list[Column] = []
        for k, piece in enumerate(_pieces(self.template)):
            out.append(row[piece] if k % 2 and piece in row else F.lit(fixed.get(piece, "") if k % 2 else piece))
        return F.concat(*out)


def prompts(chunks: DataFrame, template: PromptTemplate, text_col: str = "text", context_col: str | None = None) -> DataFrame:
    """chunks with the column prompt."""
    return chunks.withColumn("prompt", template.column(F.col(text_col), F.col(context_col) if context_col else None))


def refinement_context(found: DataFrame, id_col: str = "doc_id", base: str = "") -> DataFrame:
    """(doc_id, context): what earlier passes found in each document, by class in order; one shuffle by document."""
    order = [c for c in ("pass_number", "chunk_id", "ordinal") if c in found.columns]
    by = found.groupBy(id_col, "extraction_class").agg(F.array_sort(F.collect_list(F.struct(*order, "extraction_text"))).alias("_x"))
    line = F.concat(F.lit("\n- "), F.col("extraction_class"), F.lit(": "), F.array_join(F.transform("_x", lambda x: x["extraction_text"]), ", "))
    g = by.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("extraction_class", line.alias("line")))).alias("_l"))
    return g.select(id_col, F.concat(F.lit(base + "\n\nPrevious extractions found:"), F.array_join(F.transform("_l", lambda x: x["line"]), ""), F.lit(MORE)).alias("context"))
