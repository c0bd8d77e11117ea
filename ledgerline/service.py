"""A small web service over the runs: health, one file, many files, and intake with a callback. Plain WSGI, off unless started."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterable, Mapping
from email.parser import BytesParser
from email.policy import HTTP
from urllib.parse import parse_qs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tables as t
from .operators import retry
from .plans import runs
from .sources import folders

#: Names of the settings in the environment: where results go, and what the receiver wants as proof.
CALLBACK_URL, CALLBACK_KEY, CALLBACK_TOKEN = "EXTRACTOR_CALLBACK_URL", "EXTRACTOR_CALLBACK_API_KEY", "EXTRACTOR_CALLBACK_BEARER_TOKEN"

File = tuple[str, bytes]


def callback_config(environment: Mapping[str, str] = os.environ) -> tuple[str, dict[str, str]]:
    """(url, headers), read anew on each call; an empty url, as by default, sends nothing."""
    headers = {"Content-Type": "application/json"}
    if environment.get(CALLBACK_KEY):
        headers["X-API-KEY"] = environment[CALLBACK_KEY]
    if environment.get(CALLBACK_TOKEN):
        headers["Authorization"] = f"Bearer {environment[CALLBACK_TOKEN]}"
    return environment.get(CALLBACK_URL, ""), headers


def http_post(url: str, headers: dict[str, str], body: bytes) -> tuple[int, str]:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, body, headers), timeout=30) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def send_results(job_id: int, results: list[dict], environment: Mapping[str, str] = os.environ, post=http_post) -> dict:
    """Posts the results of a job and says what came of it; never raises."""
    url, headers = callback_config(environment)
    if not url:
        return {"sent": False, "reason": "no callback is set"}
    try:
        status, text = post(url, headers, json.dumps({"job_id": job_id, "results": results}, ensure_ascii=False).encode())
    except Exception as e:
        return {"sent": False, "error": str(e)}
    ok = 200 <= status < 300
    return {"sent": ok, "status_code": status} | ({} if ok else {"response": text[:300]})


def unique_names(names: Iterable[str]) -> list[str]:
    """Names of one request: later ones that are equal, whatever their case, get _2, _3 and so on before their ending."""
    used: set[str] = set()
    out = []
    for name in names:
        stem, dot, ending = name.rpartition(".")
        n, new = 1, name
        while new.lower() in used:
            n += 1
            new = f"{stem or ending}_{n}{dot}{ending if stem else ''}"
        used.add(new.lower())
        out.append(new)
    return out


class Service:
    """`read` turns (doc_id, content) into texts, `extract` texts into raw headers and items; both run in Spark, a request's files as one table."""

    def __init__(self, spark: SparkSession, read: Callable[[DataFrame], DataFrame], extract: retry.Extract, folder: str, model: str = t.PRICES[-1][0], ending: str = ".pdf", environment: Mapping[str, str] = os.environ, post=http_post):
        self.spark, self.read, self.extract, self.folder = spark, read, extract, folder.rstrip("/")
        self.model, self.ending, self.environment, self.post = model, ending, environment, post

    def health(self) -> dict:
        sheets = {"export": [t.EXPORT_SHEET, *t.EMPTY_SHEETS["export"]], "import": [t.IMPORT_SHEET, *t.EMPTY_SHEETS["import"]]}
        return {"status": "ok", "templates": sheets, "default_model": self.model}

    def process(self, files: list[File], shipment: str | None = None, max_retries: int = retry.MAX_RETRIES, save: bool = True) -> list[dict]:
        """One result or {"source_file", "error"} for each file, in order; finished results are saved under `folder`."""
        wrong = {i: {"source_file": name, "error": f"only {self.ending} files are read"} for i, (name, _) in enumerate(files) if not name.lower().endswith(self.ending)}
        rows = [(i, name, bytearray(content)) for i, (name, content) in enumerate(files) if i not in wrong]
        if not rows:
            return [wrong[i] for i in range(len(files))]
        docs = folders.checkpointed(self.spark.createDataFrame(rows, "doc_id long, name string, content binary"))
        done = folders.checkpointed(runs.results(self.read(docs.select("doc_id", "content")), self.extract, shipment or "auto", max_retries=max_retries, spent=getattr(self.extract, "spent", lambda: None)).join(docs.select("doc_id", "name"), "doc_id"))
        if save:
            folders.write_documents(done.filter("status = 'ok'").select("doc_id", "name", "valid", "result"), self.folder)
        out = dict(wrong)
        for row in done.select("doc_id", "name", "status", "result").collect():  # one request's files
            result = json.loads(row["result"]) | {"source_file": row["name"]}
            out[row["doc_id"]] = result if row["status"] == "ok" else {"source_file": row["name"], "document_type": result.get("document_type"), "error": row["status"]}
        return [out[i] for i in range(len(files))]

    def save(self, job_id: int, files: list[File], shipment: str | None = None) -> dict:
        """First saves all files of a job under their own names, then extracts what was saved, then calls back."""
        entries = []
        for (name, content), new in zip(files, unique_names(re.split(r"[/\\]", name)[-1] for name, _ in files), strict=True):
            entry = {"file_name": name, "saved_path": None, "document_type": None, "extraction_status": "failed", "extracted_json": None, "error": None}
            entries.append(entry)
            if not name.lower().endswith(self.ending):
                entry["error"] = f"only {self.ending} files are read"
                continue
            try:
                place = os.path.join(self.folder, "jobs", str(int(job_id)))
                os.makedirs(place, exist_ok=True)
                path = os.path.join(place, new)
                with open(path, "wb") as out:
                    out.write(content)
                entry["saved_path"] = path
            except OSError as e:
                entry["error"] = f"not saved: {e}"
        saved = [e for e in entries if e["saved_path"]]
        contents = []
        for entry in saved:
            with open(entry["saved_path"], "rb") as file:
                contents.append((entry["file_name"], file.read()))
        for entry, result in zip(saved, self.process(contents, shipment, save=False) if contents else [], strict=True):
            if "error" in result and result["error"]:
                entry["error"] = result["error"]
            else:
                entry |= {"extracted_json": result, "document_type": result.get("document_type"), "extraction_status": "success"}
        told = [e["extracted_json"] or {"source_file": e["file_name"], "document_type": None, "error": e["error"]} for e in entries]
        return {"job_id": job_id, "shipment_type": shipment, "results": entries, "callback": send_results(job_id, told, self.environment, self.post)}

    def __call__(self, environ: dict, start_response) -> list[bytes]:
        """The WSGI application."""
        status, answer = self.answer(environ)
        body = json.dumps(answer, ensure_ascii=False).encode()
        start_response(status, [("Content-Type", "application/json"), ("Content-Length", str(len(body)))])
        return [body]

    def answer(self, environ: dict) -> tuple[str, dict]:
        route = (environ.get("REQUEST_METHOD", "GET"), environ.get("PATH_INFO", "/"))
        asked = {k: x[0] for k, x in parse_qs(environ.get("QUERY_STRING", "")).items()}
        if route == ("GET", "/health"):
            return "200 OK", self.health()
        if route not in (("POST", "/extract"), ("POST", "/extract-batch"), ("POST", "/save-pdf")):
            return "404 Not Found", {"detail": "no such route"}
        if asked.get("type") not in (None, "import", "export") or not asked.get("max_retries", "0").isdigit():
            return "422 Unprocessable Content", {"detail": "type is import or export, max_retries a number"}
        files, fields = multipart(environ)
        shipment, tries = asked.get("type"), int(asked.get("max_retries", retry.MAX_RETRIES))
        if not files:
            return "422 Unprocessable Content", {"detail": "no file"}
        if route[1] == "/save-pdf":
            job = asked.get("job_id") or fields.get("job_id", "")
            if not job.isdigit():
                return "422 Unprocessable Content", {"detail": "job_id is a number"}
            return "200 OK", self.save(int(job), files, shipment or fields.get("shipment_type") or None)
        results = self.process(files if route[1] == "/extract-batch" else files[:1], shipment, tries)
        if route[1] == "/extract-batch":
            return "200 OK", {"results": results}
        return ("422 Unprocessable Content", {"detail": results[0]["error"]}) if results[0].get("error") else ("200 OK", results[0])


def multipart(environ: dict) -> tuple[list[File], dict[str, str]]:
    """The files and the other fields of a form."""
    body = environ["wsgi.input"].read(int(environ.get("CONTENT_LENGTH") or 0))
    message = BytesParser(policy=HTTP).parsebytes(f"Content-Type: {environ.get('CONTENT_TYPE', '')}\r\n\r\n".encode() + body)
    files, fields = [], {}
    for part in message.iter_parts() if message.is_multipart() else ():
        name = part.get_filename()
        if name is not None:
            files.append((name, part.get_payload(decode=True) or b""))
        else:
            fields[part.get_param("name", header="content-disposition")] = (part.get_payload(decode=True) or b"").decode()
    return files, fields


def form(files: list[File], boundary: str | None = None) -> tuple[str, bytes]:
    """(content type, body) of a form with files, for callers without a library for it."""
    boundary = boundary or uuid.uuid4().hex
    parts = [f'--{boundary}\r\nContent-Disposition: form-data; name="files"; filename="{name}"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode() + content + b"\r\n" for name, content in files]
    return f"multipart/form-data; boundary={boundary}", b"".join(parts) + f"--{boundary}--\r\n".encode()


def landed(docs: DataFrame) -> DataFrame:
    """(doc_id, content) of saved files, for `read`."""
    return docs.select(F.col("doc_id"), F.col("content"))
