"""Webhooks: verification, event filter, and payloads as episodes, for a table or stream of deliveries."""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rest import to_episodes


@dataclass
class WebhookSource:
    """A registered source; the secret is never shown."""

    id: str
    source_type: str
    secret: str | None = None
    signature_prefix: str = "sha256="
    algorithm: str = "sha256"
    allowed_events: tuple[str, ...] = ()
    content_template: str | None = None
    source_id_template: str | None = None
    extra: dict = field(default_factory=dict)

    def shown(self) -> dict:
        return {"id": self.id, "source_type": self.source_type, "secret": "***" if self.secret else None, "allowed_events": list(self.allowed_events)}


def signature(body: Column, secret: str, algorithm: str = "sha256") -> Column:
    """Hex HMAC of a text: there is no built-in, so Arrow batches."""

    @F.pandas_udf("string")
    def sign(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else hmac.new(secret.encode(), b.encode(), algorithm).hexdigest())

    return sign(body)


def verified(deliveries: DataFrame, source: WebhookSource) -> DataFrame:
    """Deliveries (body, signature, event) that are signed right and of an allowed event; a missing event passes."""
    out = deliveries
    if source.secret:
        out = out.filter(F.col("signature") == F.concat(F.lit(source.signature_prefix), signature(F.col("body"), source.secret, source.algorithm)))
    if source.allowed_events:
        out = out.filter(F.col("event").isNull() | F.col("event").isin(list(source.allowed_events)))
    return out


def receive(deliveries: DataFrame, source: WebhookSource) -> DataFrame:
    rows = verified(deliveries, source).select(F.lit(source.source_type).alias("source_type"), F.col("body").alias("payload"))
    return to_episodes(rows, content=source.content_template, source_id=source.source_id_template)


def local_signature(body: str, source: WebhookSource) -> str:
    """The signature of one body, as a sender makes it."""
    return source.signature_prefix + hmac.new((source.secret or "").encode(), body.encode(), getattr(hashlib, source.algorithm)).hexdigest()
