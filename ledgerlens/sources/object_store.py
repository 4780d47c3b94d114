"""Object-store access as session settings (S3-compatible stores via ``s3a://``).

Credentials are passed in by the caller (or come from the cluster's own
credential provider); nothing is read from the environment here.
"""

from __future__ import annotations


def s3a_settings(endpoint: str, access_key: str | None = None, secret_key: str | None = None, *,
                 path_style: bool = True, ssl: bool = False) -> dict[str, str]:
    """``spark.hadoop.fs.s3a.*`` settings for an S3-compatible endpoint."""
    conf = {
        "spark.hadoop.fs.s3a.endpoint": endpoint,
        "spark.hadoop.fs.s3a.path.style.access": str(path_style).lower(),
        "spark.hadoop.fs.s3a.connection.ssl.enabled": str(ssl).lower(),
    }
    if access_key is not None:
        conf["spark.hadoop.fs.s3a.access.key"] = access_key
    if secret_key is not None:
        conf["spark.hadoop.fs.s3a.secret.key"] = secret_key
    return conf


def with_settings(builder, settings: dict[str, str]):
    """Apply settings to a ``SparkSession.builder``."""
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder
