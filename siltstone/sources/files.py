"""Table addresses, and files of any Hadoop file system from the driver."""

from __future__ import annotations

import re
from pathlib import Path
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from siltstone.errors import InvalidTableUri, StorageInitialization

# Option names that say how S3 credentials are found.
_STATIC = ({"aws_access_key_id", "access_key_id"}, {"aws_secret_access_key", "secret_access_key"})
_WEB_IDENTITY = ({"aws_web_identity_token_file", "web_identity_token_file"}, {"aws_role_arn", "role_arn"})
_CONTAINER = ({"aws_container_credentials_relative_uri", "container_credentials_relative_uri"},)
_CONTAINER_FULL = (
    {"aws_container_credentials_full_uri", "container_credentials_full_uri"},
    {"aws_container_authorization_token_file", "container_authorization_token_file"},
)
_OTHER = {
    "aws_session_token", "aws_token", "session_token", "token", "aws_role_session_name", "role_session_name", "aws_endpoint_url_sts", "endpoint_url_sts",
    "aws_imdsv1_fallback", "imdsv1_fallback", "aws_metadata_endpoint", "metadata_endpoint", "aws_unsigned_payload", "unsigned_payload",
    "aws_skip_signature", "skip_signature",
}

#: Characters, besides letters, digits and what is not ASCII, that a java.net.URI keeps in a path.
_URI_KEEPS = "/_-!.~'()*,;:$&+=@"


def normalized_uri(address: str) -> str:
    """A path or URL as the URL of a folder, without a closing slash."""
    if not address or not address.strip():
        raise InvalidTableUri("empty_table_uri")
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", address):
        if not urlsplit(address).path.strip("/") and not urlsplit(address).netloc:
            raise InvalidTableUri("invalid_table_uri")
        return address.rstrip("/")
    if address.startswith("file:"):
        address = address[5:]
    return "file://" + encoded(str(Path(address).absolute()))


def encoded(path: str) -> str:
    """A path as Spark shows it in _metadata.file_path: illegal ASCII characters as %XX, others unchanged."""
    return re.sub(rf"[^A-Za-z0-9{re.escape(_URI_KEEPS)}\u0080-\U0010ffff]", lambda m: f"%{ord(m[0]):02X}", path)


def data_file(table: str, logged: str) -> tuple[str, str]:
    """(path for Spark's readers, key that file_key() gives) of a file as the log names it.

    The log percent-encodes; a relative name is below the table, an absolute one stands alone.
    """
    whole = logged if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", logged) else f"{table}/{logged}"
    scheme, rest = whole.split(":", 1)
    authority, path = re.match(r"(?://([^/]*))?(.*)", rest, re.S).groups()
    plain = unquote(path)
    host = f"//{authority}" if authority is not None else "//" if scheme == "file" else ""
    return f"{scheme}:{host}{plain}", f"{scheme}:{host if authority else ''}{encoded(plain)}"


def file_key() -> Column:
    """_metadata.file_path, an empty authority left out, so that file:/ and file:/// are one."""
    return F.regexp_replace("_metadata.file_path", r"^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/")


def s3_auth_mode(uri: str, options: dict[str, str]) -> str | None:
    """How credentials of an S3-compatible address are given, or None for another address."""
    parts = urlsplit(uri)
    host = (parts.hostname or "").lower()
    if not (parts.scheme in ("s3", "s3a") and host or parts.scheme == "https" and host.endswith(("amazonaws.com", "r2.cloudflarestorage.com"))):
        return None
    keys = {k.lower() for k in options}
    has = lambda sets: all(keys & s for s in sets)
    for mode, given in (("explicit_static", has(_STATIC)), ("explicit_web_identity", has(_WEB_IDENTITY)), ("explicit_container", has(_CONTAINER) or has(_CONTAINER_FULL))):
        if given:
            return mode
    known = set().union(*_STATIC, *_WEB_IDENTITY, *_CONTAINER, *_CONTAINER_FULL, _OTHER)
    return "other_explicit" if keys & known else "implicit_provider_chain"


def hadoop_conf(spark: SparkSession, options: dict[str, str] | None = None):
    """The session's Hadoop configuration with a table's own options; nothing global is changed."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for key, value in (options or {}).items():
        conf.set(key, value)
    return conf


class Folder:
    """A folder of a Hadoop file system, seen from the driver."""

    def __init__(self, spark: SparkSession, uri: str, options: dict[str, str] | None = None):
        self._jvm = spark._jvm
        try:
            self._path = self._jvm.org.apache.hadoop.fs.Path(self._jvm.java.net.URI(encoded(unquote(uri))) if "%" in uri else self._jvm.org.apache.hadoop.fs.Path(uri).toUri())
            self._fs = self._path.getFileSystem(hadoop_conf(spark, options))
        except Exception as error:
            raise StorageInitialization("object_store_initialization_failed") from error

    def names(self) -> list[str]:
        """Names of the files in the folder; empty if there is none."""
        if not self._fs.exists(self._path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path) if s.isFile())

    def write(self, name: str, data: bytes) -> None:
        out = self._fs.create(self._jvm.org.apache.hadoop.fs.Path(self._path, name), True)
        out.write(bytearray(data))
        out.close()
