"""Repository ontology: an ordered dimension of data repositories. Order matters: the first repository that matches wins."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "ord int, repo string, repo_name string, id_pattern string, page_prefix string, page_template string, repo_mapping string, "
    "repo_root string, default_suffix string, access_mode string, download_root string, needs_browser boolean"
)

_BIG, _ASK = "Complex download", "Application to access"


def _entry(repo: str, name: str | None, page: str | None = None, ids: str | None = None, mode: str | None = None, **more: Any) -> dict[str, Any]:
    return {"repo": repo, "repo_name": name, "page_template": page, "id_pattern": ids, "access_mode": mode, **more}


DEFAULT: tuple[dict[str, Any], ...] = (
    _entry("bigd.big.ac.cn", "BIGD", "https://bigd.big.ac.cn/browse/{}"),
    _entry("ega-archive.org", "European Genome-Phenome Archive", "https://ega-archive.org/studies/{}", r"EGA[SDC]\d{11}", "Contact to access"),
    _entry("massive.ucsd.edu", "MassIVE", "https://massive.ucsd.edu/ProteoSAFe/dataset.jsp?accession={}", r"MSV\d+", _BIG),
    _entry("www.ebi.ac.uk", "PRIDE", "https://www.ebi.ac.uk/pride/archive/projects/{}", None, _BIG, needs_browser=True),
    _entry("www.iprox.cn", "iProX", "https://www.iprox.cn/page/project.html?id={}", None, _BIG),
    _entry("proteomecentral.proteomexchange.org", "ProteomeCentral", "https://proteomecentral.proteomexchange.org/cgi/GetDataset?ID={}", r"\bPXD\d{5,10}", _BIG),
    _entry("www.proteomexchange.org", "ProteomeXchange", "https://proteomecentral.proteomexchange.org/cgi/GetDataset?ID={}", None, _BIG, repo_mapping="proteomecentral.proteomexchange.org"),
    _entry("pdc.cancer.gov", "Proteomic Data Commons", "https://proteomic.datacommons.cancer.gov/pdc/study/{}", r"PDC[0-9]+", _BIG + " or " + _ASK, needs_browser=True),
    _entry("gdc.cancer.gov", "Genomic Data Commons", "https://www.ncbi.nlm.nih.gov/projects/gap/cgi-bin/study.cgi?study_id={}"),
    _entry("cancerimagingarchive.net", "The Cancer Imaging Archive"),
    _entry("imaging.datacommons.cancer.gov", "Imaging Data Commons"),
    _entry("repository.jpostdb.org", "JPOST", "https://repository.jpostdb.org/entry/{}", None, _BIG),
    _entry("geo", "Gene Expression Omnibus", "https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc={}", r"G(?:SE|SM|PL|DS)\d+", _BIG),
    _entry("dbgap", "database of Genotypes and Phenotypes", "https://www.ncbi.nlm.nih.gov/projects/gap/cgi-bin/study.cgi?study_id={}", r"phs[0-9]+\.\w+\d+\.\w+\d+", _ASK, default_suffix=".v1.p1"),
    _entry("sra", "Sequence Read Archive", "https://www.ncbi.nlm.nih.gov/bioproject/?term={}", r"PRJ(?:NA|EB|DB)\d+|[SED]RP\d+", _BIG, needs_browser=True),
    _entry("arrayexpress", "ArrayExpress", "https://www.ebi.ac.uk/biostudies/ArrayExpress/studies/{}", r"E-[A-Z]{4}-\d+", _BIG, repo_root="www.ebi.ac.uk", needs_browser=True),
    _entry("nuccore", "Nucleotide", "https://www.ncbi.nlm.nih.gov/nuccore/{}", None, None, repo_root="www.ncbi.nlm.nih.gov"),
    _entry("data.mendeley.com", "Mendeley"),
    _entry("synapse.org", "Synapse", "https://www.synapse.org/Synapse:{}", r"syn\d{7,12}", _BIG + " or " + _ASK.lower(), repo_root="www.synapse.org"),
    _entry("pdb", "Protein Data Bank", "https://www.rcsb.org/structure/{}", r"\bpdb[1-9][a-zA-Z0-9]{3}\b"),
    _entry("datadryad.org", "Dryad", "https://datadryad.org/stash/dataset/{}", r"doi:10\.5061/dryad\.\w+"),
    _entry("figshare.com", "figshare", "https://figshare.com/articles/dataset/{}", r"10\.6084/m9\.figshare\.\d+"),
    _entry("zenodo.org", "zenodo", "https://zenodo.org/{}", r"\b\d{7}\b"),
)

_DOI = "https://doi.org/{}"

#: More repositories, most of them by the prefix of their DOIs.
EXTENDED: tuple[dict[str, Any], ...] = (
    *({**e, "id_pattern": None} if e["repo"] in ("ega-archive.org", "proteomecentral.proteomexchange.org") else e for e in DEFAULT[:9]),
    _entry("cancerimagingarchive.net", "The Cancer Imaging Archive", _DOI),
    _entry("imaging.datacommons.cancer.gov", "Imaging Data Commons", _DOI),
    DEFAULT[11],
    *(
        _entry(f"doi.org/{prefix}", name, _DOI, pattern)
        for prefix, name, pattern in (
            ("10.5061", "Dryad", r"10\.5061/[^\s]+"),
            ("10.5281", "Zenodo", r"10\.5281/[^\s]+"),
            ("10.6084", "Figshare", r"10\.6084/[^\s]+"),
            ("10.24433", "Mendeley Data", r"10\.24433/[^\s]+"),
            ("10.17632", "Mendeley Data", r"10\.17632/[^\s]+"),
            ("10.7910", "Dataverse", r"10\.7910/DVN[^\s]*"),
            ("10.18112", "OpenNeuro", r"10\.18112/openneuro\.[^\s]+"),
            ("10.1594", "PANGAEA", r"10\.1594/PANGAEA\.[^\s]+"),
            ("10.21233", "Neotoma Paleoecology", r"10\.21233[^\s]+"),
            ("10.3886", "ICPSR", r"10\.3886[^\s]+"),
            ("10.7289", "NOAA NCEI", r"10\.7289[^\s]+"),
            ("10.5255", "UK Data Service", r"10\.5255[^\s]+"),
            ("10.6019", "EMPIAR", r"10\.6019[^\s]+|\bEMPIAR\-\d+\b"),
        )
    ),
    _entry("doi.org", None, _DOI, r"10\.\d{4,9}/"),
    _entry("geo", "Gene Expression Omnibus", "https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc={}", r"\b(?:GSE|GSM|GPL|GDS)\d+\b", _BIG),
    DEFAULT[13],
    _entry("sra", "Sequence Read Archive", "https://www.ncbi.nlm.nih.gov/sra/?term={}", r"\b(?:SRP|SRA|ERP|ERX)\d+\b", _BIG),
    {**DEFAULT[15], "id_pattern": None},
    DEFAULT[19],
    DEFAULT[17],
    {**DEFAULT[18], "id_pattern": r"(?<!\d)syn\d{7,12}(?!\d)"},
    _entry("emdb", "Electron Microscopy Data Bank (EMDB)", "https://www.ebi.ac.uk/emdb/{}", r"\bEMD\-\d+\b"),
    _entry("genbank", "GenBank", "https://www.ncbi.nlm.nih.gov/nuccore/{}", r"\b(?:MN\w+|NC_\d+|CP\w+|MT\w+)\b"),
    _entry("metabolights", "MetaboLights", "https://www.ebi.ac.uk/metabolights/{}", r"\bMTBLS\d+\b"),
    _entry("bioproject", "BioProject", "https://www.ncbi.nlm.nih.gov/bioproject/{}", r"\bPRJ(?:NA|EB|DB)\d+\b"),
    _entry("github.com", "GitHub", "https://github.com/{}"),
)

#: Its pattern, seven digits, matches too much to search a text with.
TOO_GENERAL = ("zenodo.org",)


def load(source: str | tuple[dict[str, Any], ...] | None = None) -> list[dict[str, Any]]:
    """Entries in order, from a JSON file {"repos": {...}}, from entries given, or the default ones. In a file's template __ID__ stands for the identifier."""
    entries = source
    if isinstance(source, str):
        with open(source, encoding="utf-8") as f:
            found = json.load(f)["repos"]
        entries = tuple(
            _entry(
                key, v.get("repo_name"), (v.get("dataset_webpage_url_ptr") or "").replace("__ID__", "{}") or None, v.get("id_pattern") or v.get("ID_pattern"), v.get("access_mode"), download_root=(v.get("download_root") or "").replace("__ID__", "{}") or None,
                repo_mapping=v.get("repo_mapping"), repo_root=v.get("repo_root"), default_suffix=v.get("default_id_suffix"), needs_browser=v.get("javascript_load_required"),
            )
            for key, v in found.items()
        )
    out = []
    for k, e in enumerate(DEFAULT if entries is None else entries):
        template = e.get("page_template")
        prefix = template.split("{}")[0].lower() if template else None
        out.append({"ord": k, "page_prefix": prefix, "needs_browser": bool(e.get("needs_browser"))} | {n: e.get(n) for n in ("repo", "repo_name", "id_pattern", "page_template", "repo_mapping", "repo_root", "default_suffix", "access_mode", "download_root")})
    return out


def dimension(spark: SparkSession, source: str | tuple[dict[str, Any], ...] | None = None) -> DataFrame:
    """The ontology as a DataFrame of a few dozen rows; it doesn't grow with the corpus."""
    names = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]
    return spark.createDataFrame([tuple(e[n] for n in names) for e in load(source)], SCHEMA)


def search_patterns(source: str | tuple[dict[str, Any], ...] | None = None) -> list[tuple[str, str]]:
    """(repo, pattern) of all patterns that texts are searched with, in order."""
    return [(e["repo"], e["id_pattern"]) for e in load(source) if e["id_pattern"] and e["repo"] not in TOO_GENERAL]
