"""Model calls behind protocols, with deterministic stand-ins that need no network.

A model is a plain object that is sent to the workers; it is called with lists, an Arrow batch
at a time. ``with_retries`` spreads a batch over a few threads and repeats failed calls.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


_TOKEN = re.compile(r"[^ \t\n\r\f\x0b]+")


def lexical(text: str | None) -> dict[str, float]:
    """The words of a text with their counts as a unit vector."""
    n = Counter(_TOKEN.findall(text or ""))
    size = math.sqrt(sum(c * c for c in n.values()))
    return {w: c / size for w, c in n.items()}


def pieces(batches: Iterator[pd.DataFrame], texts: list[str], most: int = 1 << 18, rows: int = 256) -> Iterator[pd.DataFrame]:
    """Batches in slices of about ``most`` code points in the columns ``texts`` and of ``rows`` rows at
    most, so that what a model makes of a batch is bounded. An empty batch stays one."""
    for pdf in batches:
        size = sum((pdf[c].str.len().fillna(0).to_numpy(dtype=np.int64) for c in texts), np.zeros(len(pdf), dtype=np.int64))
        lo, n = 0, 0
        for i, x in enumerate(size):
            if i > lo and (n + x > most or i - lo == rows):
                yield pdf.iloc[lo:i]
                lo, n = i, 0
            n += x
        yield pdf.iloc[lo:]


class LLM(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class MultiEncoder(Encoder, Protocol):
    """An encoder with token weights and a vector for each token besides."""

    def lexical(self, texts: list[str]) -> list[dict[str, float]]: ...

    def multi(self, texts: list[str]) -> list[np.ndarray]: ...


class LogProb(Protocol):
    def score(self, prompts: list[str], targets: list[str]) -> list[float]: ...


class RuleExtractor:
    """Writes an extraction record for each capitalised word of a prompt and a relationship for
    each two that follow one another."""

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            names = list(dict.fromkeys(re.findall(r"\b[A-Z][A-Za-z]+\b", p)))
            rows = [f'("entity"<|>"{n}"<|>"NAME"<|>"{n} is named in the text")' for n in names]
            rows += [f'("relationship"<|>"{a}"<|>"{b}"<|>"{a} comes before {b}"<|>"order"<|>1)' for a, b in zip(names, names[1:])]
            out.append("##".join(rows) + "<|COMPLETE|>")
        return out


class CapitalNames:
    """Lists the capitalised words of a prompt's last line as JSON."""

    def complete(self, prompts: list[str]) -> list[str]:
        return [json.dumps(list(dict.fromkeys(re.findall(r"\b[A-Z][A-Za-z]+\b", p.rpartition("Text: ")[2])))) for p in prompts]


class Paraphrases:
    """Asks about each entity of a prompt instead of what the question asks."""

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            told = json.loads(p[p.rindex('{"original_question"') :])
            out.append("```json\n" + json.dumps({"confusing_questions": [f"{told['original_question']} {e['name']}" for e in told["entities"]]}) + "\n```")
        return out


class LengthJudge:
    """Prefers the answer whose length is nearer to the truth's."""

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            truth, one, two = (len(re.search(rf"(?m)^{k}: (.*)$", p)[1]) for k in ("Truth", "Answer 1", "Answer 2"))
            far = abs(one - truth) - abs(two - truth)
            won = {"Winner": "Tie" if not far else "Answer 1" if far < 0 else "Answer 2"}
            out.append(json.dumps({"Faithfulness": won, "Conciseness": won, "Overall": won}))
        return out


class HashedWords:
    """Words hashed to signed buckets, as unit vectors."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    def lexical(self, texts: list[str]) -> list[dict[str, float]]:
        """Word weights: counts as unit vectors."""
        return [lexical((text or "").lower()) for text in texts]

    def multi(self, texts: list[str]) -> list[np.ndarray]:
        """A vector for each different word."""
        return [self.encode(list(dict.fromkeys((text or "").lower().split()))) for text in texts]


class OverlapProxy:
    """Stands in for a mean log-probability: the share of a target's words that the prompt has, minus
    one; -inf for a target without words. Its tokens are words."""

    def score(self, prompts: list[str], targets: list[str]) -> list[float]:
        out = []
        for p, t in zip(prompts, targets):
            have, words = set((p or "").lower().split()), (t or "").lower().split()
            out.append(sum(w in have for w in words) / len(words) - 1 if words else float("-inf"))
        return out


class Failing(RuntimeError):
    """A model call that failed on every try."""


def with_retries(call: Callable[[list[str]], list[str]], tries: int = 3, wait: float = 1.0, threads: int = 4, size: int = 16, timeout: float | None = None) -> Callable[[list[str]], list[str]]:
    """Parts of ``size`` items over ``threads``; a call that fails or takes over ``timeout`` seconds is
    repeated, with waits that double."""

    def once(part: list[str]) -> list[str]:
        if timeout is None:
            return call(part)
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(call, part).result(timeout)
        finally:
            pool.shutdown(wait=False)

    def one(part: list[str]) -> list[str]:
        for i in range(tries):
            try:
                return once(part)
            except Exception as error:  # whatever a client raises
                if i == tries - 1:
                    raise Failing(f"{tries} tries: {error!r}") from error
                time.sleep(wait * 2**i)
        return []

    def run(items: list[str]) -> list[str]:
        parts = [items[i : i + size] for i in range(0, len(items), size)]
        with ThreadPoolExecutor(threads) as pool:
            return [x for part in pool.map(one, parts) for x in part]

    return run


def _tokens(text: str | None) -> int:
    return int(len((text or "").split()) / 0.75)


def complete(df: DataFrame, prompt: str, out: str, llm: LLM, usage: str | None = None, **retry) -> DataFrame:
    """df with the model's answers to a column of prompts. usage: the name of a column more, with what
    the call used (model, input_tokens, output_tokens): what the model's ``usage(prompts, answers)``
    says, or words over 0.75."""
    name = str(getattr(llm, "model", type(llm).__name__))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(llm.complete, **retry)
        for pdf in pieces(batches, [prompt]):
            prompts = pdf[prompt].tolist()
            answers = call(prompts) if len(pdf) else []
            pdf = pdf.assign(**{out: answers})
            if usage:
                used = llm.usage(prompts, answers) if hasattr(llm, "usage") else [(_tokens(p), _tokens(a)) for p, a in zip(prompts, answers)]
                pdf[usage] = [{"model": name, "input_tokens": i, "output_tokens": o} for i, o in used]
            yield pdf

    more = f", {usage}: struct<model:string,input_tokens:bigint,output_tokens:bigint>" if usage else ""
    return df.mapInPandas(run, f"{df.schema.simpleString()[7:-1]}, {out}: string{more}")


def encode(df: DataFrame, text: str, out: str, encoder: Encoder) -> DataFrame:
    """df with the encoder's vectors of a column of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, [text]):
            yield pdf.assign(**{out: list(encoder.encode(pdf[text].tolist())) if len(pdf) else []})

    return df.mapInPandas(run, f"{df.schema.simpleString()[7:-1]}, {out}: array<double>")


def hybrid_scores(df: DataFrame, query: str, text: str, out: str, encoder: MultiEncoder, weights: tuple[float, float, float]) -> DataFrame:
    """df with the weighted sum of the three scores of a query and a text: dense (dot product), sparse
    (shared token weights) and multi (the mean, over the query's token vectors, of the best of the text's)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, [text, query]):
            if not len(pdf):
                yield pdf.assign(**{out: []})
                continue
            texts, queries = pdf[text].tolist(), list(dict.fromkeys(pdf[query]))
            at = {q: i for i, q in enumerate(queries)}
            mine = [at[q] for q in pdf[query]]
            dense = (encoder.encode(queries)[mine] * encoder.encode(texts)).sum(axis=1)
            ql, qm = encoder.lexical(queries), encoder.multi(queries)
            score = []
            for i, d, lex, m in zip(mine, dense, encoder.lexical(texts), encoder.multi(texts)):
                sparse = sum(w * lex.get(token, 0.0) for token, w in ql[i].items())
                multi = float((qm[i] @ m.T).max(axis=1).mean()) if len(qm[i]) and len(m) else 0.0
                score.append(weights[0] * float(d) + weights[1] * sparse + weights[2] * multi)
            yield pdf.assign(**{out: score})

    return df.mapInPandas(run, f"{df.schema.simpleString()[7:-1]}, {out}: double")


def log_prob(df: DataFrame, prompt: str, target: str, out: str, model: LogProb, most_tokens: int | None = None) -> DataFrame:
    """df with the mean log-probability of a target column after a prompt column; -inf where it fails.
    A prompt and target of over ``most_tokens`` lose the tail of the prompt: by the model's
    ``truncate(prompt, n)`` and ``count(text)``, or by words."""
    count = getattr(model, "count", lambda text: len((text or "").split()))
    cut = getattr(model, "truncate", lambda text, n: text if len((text or "").split()) <= n else " ".join(text.split()[:n]))

    def scored(prompts: list[str], targets: list[str]) -> list[float]:
        try:
            return model.score(prompts, targets)
        except Exception:  # one that fails must not take the batch with it
            if len(prompts) == 1:
                return [float("-inf")]
            return [x for p, t in zip(prompts, targets) for x in scored([p], [t])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches, [prompt, target]):
            prompts, targets = pdf[prompt].tolist(), pdf[target].tolist()
            if most_tokens is not None:
                prompts = [cut(p, max(0, most_tokens - count(t))) for p, t in zip(prompts, targets)]
            yield pdf.assign(**{out: scored(prompts, targets) if len(pdf) else []})

    return df.mapInPandas(run, f"{df.schema.simpleString()[7:-1]}, {out}: double")
