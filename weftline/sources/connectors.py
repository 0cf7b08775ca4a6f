"""Pluggable clients: models, embeddings and fetches. No network is used here; a client is any callable."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.safety import public_address, retry_delay, safe_url

RESULT = "status string, output string, error string, attempts int"


def call_model(units: DataFrame, key: str, prompt: str, make_client: Callable[[], Callable[[str], str]], retries: int = 1, stop_after: int = 3) -> DataFrame:
    """(key, status, output, error, attempts): one answer per unit.

    ``make_client`` is called once per task. A failing call is repeated ``retries`` times; after
    ``stop_after`` units in a row that failed, the task leaves the rest ``skipped`` for a resumed run.
    """
    rows = units.select(F.col(key).alias("k"), F.col(prompt).alias("p"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, failed = make_client(), 0
        for batch in batches:
            out: list[tuple] = []
            for p in batch.column(1).to_pylist():
                if failed >= stop_after:
                    out.append(("skipped", None, None, 0))
                    continue
                error = None
                for attempt in range(1, retries + 2):
                    try:
                        out.append(("ok", client(p), None, attempt))
                        failed = 0
                        break
                    except Exception as e:
                        error = str(e)[:500]
                else:
                    failed += 1
                    out.append(("request_error", None, error, retries + 1))
            cols = list(zip(*out)) or [()] * 4
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["k", "status", "output", "error", "attempts"])

    return rows.mapInArrow(run, f"k {kind}, {RESULT}").withColumnRenamed("k", key)


def run_stage(units: DataFrame, done: DataFrame | None, key: str, prompt: str, make_client, **how) -> DataFrame:
    """Results of a stage: good results of an earlier run, and new answers for all other units."""
    if done is None:
        return call_model(units, key, prompt, make_client, **how)
    good = done.where("status = 'ok'")
    rest = units.join(good.select(key), key, "left_anti")
    return good.unionByName(call_model(rest, key, prompt, make_client, **how), allowMissingColumns=True)


def embed(rows: DataFrame, key: str, text: str, make_client: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> DataFrame:
    """(key, embedding): unit vectors, by batches; a vector that is not finite or has no length is an error."""
    source = rows.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        client = make_client()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            vectors = [v for at in range(0, len(texts), batch) for v in client(texts[at : at + batch])]
            m = np.asarray(vectors, np.float64).reshape(len(texts), -1)
            size = np.linalg.norm(m, axis=1, keepdims=True)
            if len(texts) and (not np.isfinite(m).all() or (size == 0).any()):
                raise ValueError("an embedding is not finite or has no length")
            unit = (m / np.maximum(size, 1e-300)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(unit), pa.list_(pa.float32()))], ["k", "embedding"])

    return source.mapInArrow(run, f"k {kind}, embedding array<float>").withColumnRenamed("k", key)


def fetch(urls: DataFrame, url: str, make_client, per_origin: int = 1) -> DataFrame:
    """(url, status, output, error, attempts) of every URL, the URLs of one origin in one task so that a client can pace them."""
    from weftline.functions.text import url_origin

    spread = urls.select(url).distinct().withColumn("origin", url_origin(F.col(url)))
    spread = spread.repartition(F.concat_ws("#", "origin", F.pmod(F.xxhash64(url), F.lit(per_origin)).cast("string")))
    return call_model(spread, url, url, make_client)


class Refused(ValueError):
    """A fetch that must not be made or finished."""


def safe_fetcher(transport: Callable, resolve: Callable[[str], list[str]], *, most_bytes: int = 25 << 20, redirects: int = 5, retries: int = 2, backoff: float = 1.0, most_wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], dict]:
    """A client for ``fetch``: only public http(s) targets, pinned to the address that was checked, bounded in size and redirects.

    ``transport(url, address)`` returns (status, headers, chunks) without following redirects; ``resolve`` gives
    the addresses of a host. Every hop is checked again. 429 and 5xx are tried again as the server asks.
    """

    def one(url: str) -> tuple[int, dict, bytes, str]:
        hop, hops = url, 0
        while True:
            target, why = safe_url(hop)
            if target is None:
                raise Refused(f"unsafe_url:{why}")
            addresses = resolve(urlsplit(target).hostname)
            if not addresses or not all(map(public_address, addresses)):
                raise Refused("unsafe_address")
            status, headers, chunks = transport(target, addresses[0])
            headers = {k.lower(): v for k, v in headers.items()}
            if status in (301, 302, 303, 307, 308) and headers.get("location"):
                hops += 1
                if hops > redirects:
                    raise Refused("too_many_redirects")
                hop = urljoin(target, headers["location"])
                continue
            body = bytearray()
            for chunk in chunks:
                body += chunk
                if len(body) > most_bytes:
                    raise Refused("too_large")
            return status, headers, bytes(body), target

    def client(url: str) -> dict:
        for retry in range(retries + 1):
            status, headers, body, final = one(url)
            if status != 429 and status < 500 or retry == retries:
                break
            wait = retry_delay(headers.get("retry-after"), retry, backoff, most_wait)
            if wait is None:
                break
            sleep(wait)
        return {"status_code": status, "final_url": final, "headers": headers, "body": body}

    return client
