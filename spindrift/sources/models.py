"""Model servers: an HTTP client whose failures are all verdicts, and deterministic providers for work without a server."""

from __future__ import annotations

import functools
import hashlib
import json
import math
import os
import re
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..verdicts import Refused

TRUE = ("1", "true", "yes", "on")


def base_url(raw: str | None) -> str:
    """scheme://host:port of what people write; other schemes than http and https are refused."""
    raw = (raw or "").strip()
    if not raw:
        raise Refused("invalid_request", "the server address is empty", "pass host:port")
    parsed = urllib.parse.urlparse(raw if "://" in raw else f"http://{raw}")
    if parsed.scheme not in ("http", "https"):
        raise Refused("not_permitted", f"scheme {parsed.scheme!r} is refused", "use http or https")
    if not parsed.hostname:
        raise Refused("invalid_request", f"{raw!r} has no host", "pass host:port")
    return f"{parsed.scheme}://{parsed.netloc}"


@dataclass(frozen=True)
class Config:
    url: str = "http://localhost:11434"
    allow_pull: bool = False
    allow_delete: bool = False
    allowlist: tuple[str, ...] = ()
    timeout: float = 300.0

    @classmethod
    def from_env(cls, prefix: str = "SPINDRIFT_", env=os.environ) -> Config:
        flag = lambda k: env.get(prefix + k, "").strip().lower() in TRUE
        names = tuple(x.strip() for x in env.get(f"{prefix}MODELS", "").split(",") if x.strip())
        return cls(base_url(env.get(f"{prefix}HOST", cls.url)), flag("ALLOW_PULL"), flag("ALLOW_DELETE"), names, float(env.get(f"{prefix}TIMEOUT", cls.timeout)))

    def rows(self) -> list[tuple[str, str]]:
        return [(k, str(v)) for k, v in self.__dict__.items()]


def request(config: Config, method: str, path: str, payload: dict | None = None, timeout: float | None = None) -> dict:
    """The JSON answer, or Refused with a verdict for every way to fail."""
    body = json.dumps(payload, ensure_ascii=False).encode() if payload is not None else None
    call = urllib.request.Request(config.url + path, body, {"Content-Type": "application/json"}, method=method)
    try:
        with urllib.request.urlopen(call, timeout=timeout or config.timeout) as answer:
            data = answer.read()
    except urllib.error.HTTPError as e:
        detail = e.read().decode("utf-8", "replace")[:300]
        raise Refused("model_not_found" if e.code == 404 else "ollama_error", f"HTTP {e.code}: {detail}", "check the model's name") from e
    except TimeoutError as e:
        raise Refused("timeout", f"no answer in {timeout or config.timeout} s", "allow more time or use a smaller model") from e
    except (urllib.error.URLError, OSError) as e:
        late = isinstance(getattr(e, "reason", None), TimeoutError)
        raise Refused("timeout" if late else "ollama_unreachable", str(e), "start the server or check its address") from e
    if not data.strip():
        raise Refused("empty_response", "the answer has no body", "try again")
    try:
        found = json.loads(data)
    except ValueError as e:
        raise Refused("bad_response", f"the answer is not JSON: {e}", "check the address") from e
    if isinstance(found, dict) and found.get("error"):
        raise Refused("ollama_error", str(found["error"]), "see the server's log")
    return found


def probe(config: Config) -> dict:
    """Health: verdict and version; unreachable is a verdict, not an exception."""
    try:
        return {"verdict": "ok", "version": request(config, "GET", "/api/version", timeout=5).get("version")}
    except Refused as e:
        return e.row()


class HttpEmbedder:
    """Vectors of a batch of texts; servers without the batch endpoint are asked text by text."""

    def __init__(self, config: Config, model: str):
        self.config, self.model, self.name = config, model, model

    def installed(self) -> bool:
        try:
            request(self.config, "POST", "/api/show", {"model": self.model}, timeout=30)
        except Refused as e:
            if e.verdict in ("model_not_found", "ollama_error"):
                return False
            raise
        return True

    def __call__(self, texts: list[str]) -> list[list[float]]:
        try:
            got = request(self.config, "POST", "/api/embed", {"model": self.model, "input": texts}).get("embeddings")
        except Refused as e:
            if e.verdict != "model_not_found" or not self.installed():
                raise
            got = [request(self.config, "POST", "/api/embeddings", {"model": self.model, "prompt": t}).get("embedding") for t in texts]
        if not isinstance(got, list) or len(got) != len(texts) or any(not v for v in got):
            raise Refused("bad_response", "the vectors do not match the texts", "check the model")
        return got


@functools.lru_cache(1 << 16)
def _place(word: str) -> tuple[int, float]:
    """A word's hash and sign."""
    h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
    return h, 1.0 if h >> 63 else -1.0


class HashEmbedder:
    """Unit vectors of hashed words: equal texts, equal vectors, on any machine.

    Where the words' signs cancel out, the words are counted without signs. Only a text without words has no direction.
    """

    def __init__(self, size: int = 64, name: str = "offline-hash"):
        self.size, self.name = size, name

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        v, words = [0.0] * self.size, re.findall(r"\w+", text.lower())
        for word in words:
            h, sign = _place(word)
            v[h % self.size] += sign
        if words and not any(v):
            for word in words:
                v[_place(word)[0] % self.size] += 1.0
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v] if norm else v


class HttpChat:
    """Messages -> text, thinking, done_reason, counts and durations.

    system goes before messages that have none of their own; json_mode asks for JSON; think None leaves it to the model.
    """

    def __init__(self, config: Config, model: str, *, system: str | None = None, temperature: float | None = None, max_tokens: int | None = None, json_mode: bool = False, think: bool | None = None, **options):
        self.config, self.model, self.system = config, model, system
        wanted = {"temperature": temperature, "num_predict": max_tokens}
        self.options = options | {k: v for k, v in wanted.items() if v is not None}
        self.more = ({"format": "json"} if json_mode else {}) | ({"think": think} if think is not None else {})

    def payload(self, messages: list[dict]) -> dict:
        own = any(m["role"] == "system" for m in messages)
        sent = messages if own or not self.system else [{"role": "system", "content": self.system}, *messages]
        return {"model": self.model, "messages": sent, "stream": False, "options": self.options} | self.more

    def __call__(self, messages: list[dict]) -> dict:
        got = request(self.config, "POST", "/api/chat", self.payload(messages))
        said = got.get("message") or {}
        return {"text": said.get("content") or "", "thinking": said.get("thinking") or None, **{k: got.get(k) for k in ("done_reason", "eval_count", "eval_duration", "prompt_eval_count", "load_duration")}}


class OverlapScorer:
    """Replies as a reranker would, from shared words of question and passage."""

    def __init__(self, question: str):
        self.words = set(re.findall(r"\w+", question.lower()))

    def __call__(self, messages: list[dict]) -> dict:
        passages = re.findall(r"^\[(\d+)\] \([^\n]*\)\n(.*)$", messages[-1]["content"], re.M)
        lines = [f"{i}={min(2, len(self.words & set(re.findall(r'\w+', text.lower()))))}" for i, text in passages]
        return {"text": "\n".join(lines), "thinking": None, "done_reason": "stop", "eval_count": len(lines), "eval_duration": 1, "prompt_eval_count": None, "load_duration": None}


COMPLETION = "text string, thinking string, done_reason string, eval_count bigint, eval_duration bigint, prompt_eval_count bigint, load_duration bigint, error string"


def completed(prompts: DataFrame, call, prompt: str = "prompt") -> DataFrame:
    """Adds the completion of each prompt; a failed call is a row with its error. Filter refused prompts out before.

    prompt: a column of text, which is sent as one user message, or of whole histories, arrays of (role, content).
    """
    ship(prompts.sparkSession)
    names = prompts.columns
    fields = [f.split() for f in COMPLETION.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for p in batch.column(prompt).to_pylist():
                try:
                    rows.append(call([{"role": "user", "content": p or ""}] if p is None or isinstance(p, str) else [{"role": m["role"], "content": m["content"]} for m in p]) | {"error": None})
                except Refused as e:
                    rows.append({"error": f"{e.verdict}: {e.error}"})
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r.get(k) for r in rows], pa.string() if t == "string" else pa.int64()) for k, t in fields)], [*names, *(k for k, _ in fields)])

    return prompts.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", " + COMPLETION)


ANSWERS = "item string, qid string, type string, choice string, noul double, score double, probabilities map<string,double>, confidence double, error string"


def decided(states: DataFrame, call, questions: dict, item: str = "item", state: str = "state") -> DataFrame:
    """item, qid, type, choice, noul, score, probabilities, confidence, error: the answers about each row of states(item, state).

    call: state and questions -> answers. Every question has a row for every item: one without an answer has a null type,
    and a call that was refused says so in error. Hold the rows against the questions with operators.decisions.
    """
    ship(states.sparkSession)
    kinds = [pa.string()] * 4 + [pa.float64(), pa.float64(), pa.map_(pa.string(), pa.float64()), pa.float64(), pa.string()]
    names = [f.split()[0] for f in ANSWERS.split(", ")]
    number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None

    def run(batches):
        for batch in batches:
            rows = []
            for i, s in zip(batch.column("item").to_pylist(), batch.column("state").to_pylist(), strict=True):
                try:
                    answers, error = call(s or "", questions), None
                except Refused as e:
                    answers, error = {}, f"{e.verdict}: {e.error}"
                for qid in questions:
                    a = answers.get(qid) if isinstance(answers.get(qid), dict) else {}
                    odds = [(str(k), number(v)) for k, v in a["probabilities"].items()] if isinstance(a.get("probabilities"), dict) else None
                    rows.append((i, qid, a.get("type"), a.get("choice"), number(a.get("noul")), number(a.get("score")), odds, number(a.get("confidence")), error))
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

    return states.select(F.col(item).cast("string").alias("item"), F.col(state).cast("string").alias("state")).mapInArrow(run, ANSWERS)


class OverlapDecider:
    """Answers as a decision model would, from shared words of the state and each label or level; offline."""

    def __call__(self, state: str, questions: dict) -> dict:
        words, out = set(re.findall(r"\w+", state.lower())), {}
        if not words:
            raise Refused("invalid_request", "state is empty", "pass what is to be decided about")
        for qid, q in questions.items():
            shared = lambda t: 1.0 + len(words & set(re.findall(r"\w+", str(t).lower())))
            if q["type"] == "noul":
                mass = shared(q["instructions"])
                out[qid] = {"type": "noul", "noul": mass / (mass + 1), "confidence": mass / (mass + 1)}
                continue
            options = q["labels"] if q["type"] == "choice" else {str(k): v for k, v in enumerate(q["levels"])}
            mass = {k: shared(f"{k} {v}") for k, v in (options.items() if isinstance(options, dict) else ((o, o) for o in options))}
            odds = {k: v / sum(mass.values()) for k, v in mass.items()}
            best = max(sorted(odds), key=odds.get)
            out[qid] = {"type": q["type"], "probabilities": odds, "confidence": odds[best]} | ({"choice": best} if q["type"] == "choice" else {"score": sum(int(k) * v for k, v in odds.items())})
        return out


def models_table(spark, config: Config) -> DataFrame:
    """name, size, family, parameter_size, quantization, modified of every installed model."""
    found = request(config, "GET", "/api/tags").get("models") or []
    rows = [(m.get("name") or m.get("model"), m.get("size"), *((m.get("details") or {}).get(k) for k in ("family", "parameter_size", "quantization_level")), m.get("modified_at")) for m in found]
    return spark.createDataFrame(rows, "name string, size bigint, family string, parameter_size string, quantization string, modified string")


def running_table(spark, config: Config) -> DataFrame:
    """name, size, size_vram, expires of every loaded model."""
    rows = [(m.get("name"), m.get("size"), m.get("size_vram"), m.get("expires_at")) for m in request(config, "GET", "/api/ps").get("models") or []]
    return spark.createDataFrame(rows, "name string, size bigint, size_vram bigint, expires string")


def details_table(spark, config: Config, names: list[str]) -> DataFrame:
    """name, model_info, parameters, capabilities, error: a model whose details fail is a row that says why."""
    rows = []
    for name in names:
        try:
            d = request(config, "POST", "/api/show", {"model": name}, timeout=30)
            info = {k: str(v) for k, v in (d.get("model_info") or {}).items()}
            rows.append((name, info, d.get("parameters"), d.get("capabilities"), None))
        except Refused as e:
            rows.append((name, None, None, None, e.verdict))
    return spark.createDataFrame(rows, "name string, model_info map<string,string>, parameters string, capabilities array<string>, error string")


def server_table(spark, config: Config) -> DataFrame:
    """The configuration and the server's health as setting, value."""
    health = probe(config)
    return spark.createDataFrame([*config.rows(), *((f"server_{k}", str(v)) for k, v in health.items())], "setting string, value string")


class HttpDecider:
    """state and questions -> answers, raw; to be held against the questions by operators.decisions."""

    def __init__(self, config: Config, model: str):
        self.config, self.model = config, model

    def __call__(self, state: str, questions: dict) -> dict:
        if not state.strip():
            raise Refused("invalid_request", "state is empty", "pass what is to be decided about")
        answers = request(self.config, "POST", "/v1/systemone", {"model": self.model, "state": state, "questions": questions}).get("answers")
        if not isinstance(answers, dict):
            raise Refused("bad_response", "the answer has no answers", "check the model")
        return answers


def pull(config: Config, model: str) -> dict:
    from ..operators.budget import check_write

    check_write("pull", allow_pull=config.allow_pull)
    return request(config, "POST", "/api/pull", {"model": model, "stream": False}, timeout=3600)


def delete(config: Config, model: str) -> dict:
    from ..operators.budget import check_write

    check_write("delete", allow_delete=config.allow_delete)
    return request(config, "DELETE", "/api/delete", {"model": model})
