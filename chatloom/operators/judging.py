"""A judge that answers a checklist: its prompt, and calls with the parser inside the retry loop."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.operators.in_flight import answered
from chatloom.operators.model_calls import Client, Reply, sender
from chatloom.operators.prompts import numbered
from chatloom.runtime import ship

#: The parts of the judge's prompt, between which history, query, response, checklist and its length stand.
JUDGE = (
    """# Instruction
You are an expert evaluator. Your task is to evaluate an AI-generated response against a set of specific quality criteria. For **each** criterion you must make a binary judgment: satisfied or not satisfied.

# Conversation between User and AI
## History
<|begin_of_history|>
""",
    """
<|end_of_history|>

## Current User Query
<|begin_of_query|>
""",
    """
<|end_of_query|>

## AI Response
<|begin_of_response|>
""",
    """
<|end_of_response|>

# Evaluation Criteria
You must evaluate the AI response against each of the following checklist items. For every item, decide whether the response **satisfies** the criterion (true) or **does not satisfy** it (false).

""",
    """

# Rules
- Evaluate each item independently.
- A criterion is "satisfied" only if the response **clearly and sufficiently** meets it. If the response partially meets a criterion but has notable gaps, mark it as not satisfied.
- Provide a brief reasoning (1-2 sentences) for each judgment.

# Output Format
Return a JSON array with one object per checklist item, in the same order as the criteria above. Each object must have exactly three fields: "item" (the criterion number, 1-indexed), "satisfied" (boolean true/false), and "reasoning" (string).

```json
[
  {"item": 1, "satisfied": true, "reasoning": "..."},
  {"item": 2, "satisfied": false, "reasoning": "..."}
]
```

IMPORTANT: You must output a valid JSON array inside a ```json code block. The array must contain exactly """,
    """ objects, one per criterion, in order.""",
)
#: Where verdicts stand in an answer, and backslashes that JSON does not know.
FENCED, WIDEST, STRAY = r"```(?:json)?\s*(\[.*?\])\s*```", r"\[.*\]", r'\\(?!["\\/bfnrtu])'


def judge_prompt(history: Column, query: Column, response: Column, checklist: Column) -> Column:
    parts = (history, query, response, numbered(checklist), F.size(checklist).cast("string"))
    return F.concat(F.lit(JUDGE[0]), *(x for part, text in zip(parts, JUDGE[1:], strict=True) for x in (part, F.lit(text))))


def read_verdicts(answer: str, n_items: int) -> list[dict] | None:
    """item, satisfied and reasoning of each verdict of an answer, or None if it can't be used."""
    found = re.search(FENCED, answer, re.DOTALL)
    wide = None if found else re.search(WIDEST, answer, re.DOTALL)
    raw = found[1] if found else wide[0] if wide else answer
    data = None
    for text in (raw, re.sub(STRAY, r"\\\\", raw)):
        try:
            data = json.loads(text)
            break
        except ValueError:
            continue
    if not isinstance(data, list) or (not data and n_items):
        return None
    words, out = {"true": True, "false": False}, []
    for x in data:
        says = x.get("satisfied") if isinstance(x, dict) else None
        says = words.get(says.lower()) if isinstance(says, str) else says
        if not isinstance(says, bool):
            return None
        out.append({"item": x.get("item"), "satisfied": says, "reasoning": str(x.get("reasoning", ""))})
    return out


VERDICT = "array<struct<item:string,satisfied:boolean,reasoning:string>>"
_ADDED = "verdicts {}, satisfaction_rate double, n_satisfied long, n_total long, raw_output string, prompt_tokens long, completion_tokens long, total_tokens long, attempts long, failed boolean"


def temperature(attempt: int) -> float:
    """The first attempt is the likeliest answer, later ones vary."""
    return 0.3 if attempt else 0.0


def judge(rows: DataFrame, prompt: str, n_items: str, client: Callable[[], Client], attempts: int = 8, wait: float = 0.0, window: int = 1, ports: list[int] | None = None) -> DataFrame:
    """``rows`` with the judge's verdicts, rates, raw answer and usage; an answer that can't be read is asked for again.

    The client gets a list of one prompt and the temperature of the attempt; a partition has ``window`` requests in flight at most,
    on the ``ports`` with the fewest. Token counts and the raw answer are those of the last reply; after an exception the row pauses
    for ``wait * (2 n + 0.5)``.
    """
    ship(rows.sparkSession)
    names = rows.columns
    added = _ADDED.format(VERDICT)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, {added}"
    kind = pa.list_(pa.struct([("item", pa.string()), ("satisfied", pa.bool_()), ("reasoning", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = sender(client, ports)

        def one(row: tuple) -> tuple[list[dict] | None, Reply, int]:
            last = Reply("")
            for n in range(attempts):
                r = send(row[0], temperature(n))
                if isinstance(r, Exception):
                    if wait and n + 1 < attempts:
                        time.sleep(wait * (2 * n + 0.5))
                    continue
                last = r
                if (found := read_verdicts(r.text or "", row[1])) is not None:
                    return found, last, n + 1
            return None, last, attempts

        for b, got in answered(batches, [prompt, n_items], one, window):
            found, last = [g[0] for g in got], [g[1] for g in got]
            good = [None if f is None else sum(v["satisfied"] for v in f) for f in found]
            size = [None if f is None else len(f) for f in found]
            rate = [None if s is None else g / s if s else 0.0 for g, s in zip(good, size, strict=True)]
            shown = [None if f is None else [{**v, "item": None if v["item"] is None else str(v["item"])} for v in f] for f in found]
            total = [None if r.prompt_tokens is None or r.completion_tokens is None else r.prompt_tokens + r.completion_tokens for r in last]
            cols = [
                pa.array(shown, kind), pa.array(rate, pa.float64()), pa.array(good, pa.int64()), pa.array(size, pa.int64()), pa.array([r.text or "" for r in last], pa.string()),
                pa.array([r.prompt_tokens for r in last], pa.int64()), pa.array([r.completion_tokens for r in last], pa.int64()), pa.array(total, pa.int64()),
                pa.array([g[2] for g in got], pa.int64()), pa.array([f is None for f in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in names], *cols], [*names, *(x.split()[0] for x in ("verdicts", "satisfaction_rate", "n_satisfied", "n_total", "raw_output", "prompt_tokens", "completion_tokens", "total_tokens", "attempts", "failed"))])

    return rows.mapInArrow(run, schema)
