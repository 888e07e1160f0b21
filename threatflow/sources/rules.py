"""Signature rules: the stock table, loading, adding and removing.

A rule set is configuration, a few dozen rows, so it lives on the driver as a
list of ``Rule`` and is turned into column expressions by the signature operator.
"""

import re
import warnings
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession, functions as F


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str = "medium"
    tags: tuple = ()
    protocol: str | None = None
    src_ports: tuple = ()
    dst_ports: tuple = ()
    patterns: tuple = ()
    equals: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)
    description: str = ""


WEB = {"protocol": "tcp", "dst_ports": (80, 443, 8080)}
DNS = {"protocol": "udp", "dst_ports": (53,)}

# The stock rules, in the order in which they are tried.
STOCK_RULES = [
    Rule("sqli-basic", "SQL Injection", "high", ("web", "injection"), **WEB, patterns=(
        r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|DROP|UNION|ALTER)\b",
        r"(?i)\bOR\s+1=1\b",
        r"(?i)(['\"]\s*or\s*['\"])",
        r"(?i)--",
    )),
    Rule("sqli-blind", "SQL Injection", "high", ("web", "injection"), **WEB, patterns=(
        r"(?i)\b(SLEEP|BENCHMARK|WAITFOR\s+DELAY)\b",
        r"(?i)\bIF\s*\(.*,.*,.*\)",
        r"(?i)\bCASE\s+WHEN\b",
    )),
    Rule("xss-basic", "Cross-Site Scripting", "medium", ("web", "injection"), **WEB, patterns=(
        r"(?i)<script[^>]*>.*?</script>",
        r"(?i)on\w+\s*=",
        r"(?i)javascript:",
    )),
    Rule("xss-dom", "Cross-Site Scripting", "medium", ("web", "injection"), **WEB, patterns=(
        r"(?i)document\.(cookie|location|write)",
        r"(?i)window\.(location|open)",
        r"(?i)eval\s*\(",
    )),
    Rule("cmd-injection", "Command Injection", "high", ("system", "execution"), patterns=(
        r"(?i)[;&|]+\s*(?:cat|ls|bash|sh|powershell|whoami|wget|curl)\b",
        r"(?i);\s*rm\s+-rf",
    )),
    Rule("cmd-injection-advanced", "Command Injection", "critical", ("system", "execution"), patterns=(
        r"(?i)\b(nc|ncat|netcat)\s+-[elp]",
        r"(?i)\bbash\s+-i\s*>\s*&",
        r"(?i)\bpython\s+-c\s+['\"]import\s+socket",
    )),
    Rule("log4shell", "Log4Shell Exploit", "critical", ("java", "rce"), patterns=(
        r"(?i)\$\{jndi:(?:ldap|rmi|dns|http)[^}]+\}",
    )),
    Rule("path-traversal", "Path Traversal", "medium", ("filesystem",), patterns=(
        r"\.\./\.\./",
        r"(?i)etc/passwd",
        r"(?i)windows[/\\]system32",
    )),
    Rule("ssrf-basic", "SSRF Attack", "high", ("web", "ssrf"), **WEB, patterns=(
        r"(?i)(127\.0\.0\.1|localhost|0\.0\.0\.0|169\.254\.169\.254)",
        r"(?i)http://internal",
        r"(?i)file:///",
    )),
    Rule("xxe-basic", "XXE Injection", "high", ("web", "injection"), **WEB, patterns=(
        r"(?i)<!ENTITY\s+\w+\s+SYSTEM",
        r"(?i)<!DOCTYPE[^>]*\[.*<!ENTITY",
    )),
    Rule("deserialization", "Deserialization Attack", "critical", ("rce", "deserialization"), patterns=(
        r"(?i)java\.lang\.Runtime",
        r"(?i)rO0ABX",
        r"(?i)__import__\s*\(\s*['\"]os['\"]\s*\)",
    )),
    Rule("ftp-bruteforce", "FTP Brute Force Signature", "medium", ("bruteforce",),
         equals={"service": "ftp"}, metadata={"category": "bruteforce"}),
    Rule("ssh-bruteforce", "SSH Brute Force", "high", ("bruteforce", "ssh"), "tcp", dst_ports=(22,), patterns=(
        r"(?i)(failed\s+password|authentication\s+failure)",
        r"(?i)(invalid\s+user|no\s+such\s+user)",
    )),
    Rule("rdp-bruteforce", "RDP Brute Force", "high", ("bruteforce", "rdp"), "tcp", dst_ports=(3389,), patterns=(
        r"(?i)(negotiation\s+request|connection\s+attempt)",
    )),
    Rule("credential-dump", "Credential Dumping", "critical", ("credential", "persistence"), patterns=(
        r"(?i)(mimikatz|lsass\.exe|procdump|sekurlsa)",
        r"(?i)(hashdump|cached_credentials)",
    )),
    Rule("ransomware-c2", "Ransomware C2 Callback", "critical", ("ransomware", "c2", "malware"), patterns=(
        r"(?i)(encrypt|ransom|bitcoin|btc|monero|xmr|decrypt_key)",
        r"(?i)\.onion[:/]",
        r"(?i)(lockbit|conti|ryuk|revil|blackcat)",
    )),
    Rule("c2-beacon", "C2 Beacon Communication", "critical", ("c2", "malware", "apt"), patterns=(
        r"(?i)(beacon|heartbeat|checkin|taskings)",
        r"(?i)(cobalt[\s_-]?strike|metasploit|meterpreter)",
    )),
    Rule("crypto-mining", "Cryptocurrency Mining", "high", ("cryptomining", "malware"), patterns=(
        r"(?i)(stratum\+tcp|mining\.pool|xmrig|ethminer)",
        r'(?i)"method"\s*:\s*"mining\.(subscribe|authorize|submit)"',
        r"(?i)(coinminer|cryptonight)",
    )),
    Rule("webshell-detection", "Web Shell Upload", "critical", ("webshell", "persistence"), patterns=(
        r"(?i)(eval\s*\(\s*base64_decode|system\s*\(\s*\$_)",
        r"(?i)(cmd\.php|shell\.php|c99|r57|b374k)",
        r"(?i)(china\s*chopper|godzilla\s*webshell)",
    )),
    Rule("dns-tunneling", "DNS Tunneling", "high", ("dns", "exfiltration", "tunneling"), **DNS, patterns=(
        r"(?i)\.(?:[a-z0-9]{30,})\.\w+$",
        r"(?i)(iodine|dnscat|dns2tcp)",
    )),
    Rule("port-scan", "Port Scanning", "medium", ("reconnaissance", "scanning"), patterns=(
        r"(?i)(nmap|masscan|zmap|unicornscan)",
        r"(?i)SYN\s+scan",
    )),
    Rule("icmp-tunnel", "ICMP Tunneling", "medium", ("tunneling", "exfiltration"), "icmp", patterns=(
        r"(?i)(ptunnel|icmpsh|icmp_tunnel)",
    )),
    Rule("arp-spoofing", "ARP Spoofing", "high", ("mitm", "spoofing"), patterns=(
        r"(?i)(arp.*spoof|arp.*poison|ettercap|arpwatch)",
    )),
    Rule("smb-exploit", "SMB Exploitation", "critical", ("smb", "exploit"), "tcp", dst_ports=(445, 139), patterns=(
        r"(?i)(eternalblue|ms17.?010|smbghost)",
        r"(?i)(psexec|smbexec|wmiexec)",
    )),
    Rule("data-exfil-large", "Data Exfiltration", "high", ("exfiltration", "data_loss"), patterns=(
        r"(?i)(base64[\s_-]?encoded|gzip[\s_-]?compress)",
        r"(?i)(upload|exfil|extract|steal)",
    )),
    Rule("data-exfil-cloud", "Cloud Data Exfiltration", "high", ("exfiltration", "cloud"), patterns=(
        r"(?i)(s3\.amazonaws\.com|blob\.core\.windows\.net|storage\.googleapis\.com)",
        r"(?i)(dropbox\.com/upload|drive\.google\.com/upload)",
    )),
    Rule("email-exfil", "Email Data Exfiltration", "medium", ("exfiltration", "email"), "tcp",
         dst_ports=(25, 465, 587), patterns=(
        r"(?i)(ssn|social.security|credit.card|\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4})",
        r"(?i)(confidential|internal.only|classified)",
    )),
    Rule("lateral-psexec", "Lateral Movement", "critical", ("lateral_movement", "persistence"), patterns=(
        r"(?i)(psexec|wmic\s+/node|invoke-command)",
        r"(?i)(winrm|evil-winrm)",
    )),
    Rule("lateral-pass-hash", "Pass-the-Hash Attack", "critical", ("lateral_movement", "credential"), patterns=(
        r"(?i)(pass.the.hash|pth|overpass.the.hash)",
        r"(?i)(ntlm.relay|ntlmrelayx)",
    )),
    Rule("directory-enum", "Directory Enumeration", "low", ("reconnaissance", "web"), **WEB, patterns=(
        r"(?i)(gobuster|dirbuster|dirb|feroxbuster|ffuf)",
        r"(?i)(admin|backup|config|debug|test)\.(php|asp|jsp)",
    )),
    Rule("vuln-scanner", "Vulnerability Scanner", "low", ("reconnaissance", "scanning"), patterns=(
        r"(?i)(nikto|nuclei|burpsuite|owasp.zap|acunetix|nessus|openvas)",
    )),
    Rule("subdomain-enum", "Subdomain Enumeration", "low", ("reconnaissance", "dns"), **DNS, patterns=(
        r"(?i)(subfinder|amass|sublist3r|knockpy)",
    )),
]

# The rules used when a rule file is missing.
BUILT_IN_IDS = ["sqli-basic", "xss-basic", "cmd-injection", "log4shell", "path-traversal", "ftp-bruteforce"]


def built_in_rules():
    return [r for r in STOCK_RULES if r.id in BUILT_IN_IDS]


def rule_from(entry):
    """A rule from a mapping in the file format (``payload_patterns`` and so on)."""
    return Rule(
        id=entry["id"],
        name=entry["name"],
        severity=(entry.get("severity") or "medium").lower(),
        tags=tuple(entry.get("tags") or ()),
        protocol=entry.get("protocol"),
        src_ports=tuple(entry.get("src_ports") or ()),
        dst_ports=tuple(entry.get("dst_ports") or ()),
        patterns=tuple(entry.get("payload_patterns") or ()),
        equals=dict(entry.get("field_equals") or {}),
        metadata=dict(entry.get("metadata") or {}),
        description=entry.get("description") or "",
    )


class _Unread(Exception):
    """A pattern uses something the reader below does not know."""


def needed_texts(pattern):
    """Lower-case texts of which every match holds at least one; empty if none is known.

    A plain text search is many times cheaper than a regular expression, so payloads
    without any of these texts never reach it. Patterns with parts that are not read here
    (lookaround, back references, code points) have no such texts.
    """
    try:
        found, end = _alternatives(pattern, 0)
    except (_Unread, IndexError):
        return []
    return sorted(found) if found and end == len(pattern) and min(map(len, found)) > 1 else []


def _alternatives(p, i):
    """Texts one of which the alternatives from place ``i`` need, and where these end."""
    branches = []
    while not branches or (i < len(p) and p[i] == "|"):
        found, i = _sequence(p, i + bool(branches))
        branches.append(found)
    return (set().union(*branches) if all(branches) else set()), i


def _sequence(p, i):
    options, run = [set()], ""
    while i < len(p) and p[i] not in "|)":
        letter, inner, i = _atom(p, i)
        least, repeated, i = _repeats(p, i)
        if letter and least:
            run += letter.lower()
        if repeated or not letter:
            options += [{run}] if run else []
            run = ""
        if inner and least:
            options.append(inner)
    options += [{run}] if run else []
    # the option whose shortest text is longest filters best
    return max((o for o in options if o), key=lambda o: min(map(len, o)), default=set()), i


def _atom(p, i):
    """The letter one atom stands for, or the texts its group needs, and where it ends."""
    if p[i] == "(":
        kind = re.match(r"\((\?([imsu]+\)|[imsu]*:|<[A-Za-z]\w*>))?(?!\?)", p[i:])
        if not kind:
            raise _Unread
        if kind.group().endswith(")"):
            return "", set(), i + kind.end()
        found, end = _alternatives(p, i + kind.end())
        if p[end] != ")":
            raise _Unread
        return "", found, end + 1
    if p[i] == "[":
        known = re.match(r"\[\^?\]?([^\[\]\\]|\\.)*\]", p[i:])
        if not known:
            raise _Unread
        return "", set(), i + known.end()
    if p[i] == "\\":
        known = re.match(r"\\([pP](\{\w+\}|\w)|[dDwWsSbBAzZnrt])", p[i:])
        if known:
            return "", set(), i + known.end()
        if p[i + 1].isalnum():
            raise _Unread
        return p[i + 1], set(), i + 2
    if p[i] in "*+?{":
        raise _Unread
    return ("" if p[i] in ".^$" else p[i]), set(), i + 1


def _repeats(p, i):
    """How often at least the atom before place ``i`` occurs, whether it may repeat, and what follows."""
    found = re.match(r"([*+?]|\{(\d+)(,\d*)?\})[?+]?", p[i:])
    if not found:
        return 1, False, i
    least = int(found[2]) if found[2] else int(found[1] == "+")
    return least, True, i + found.end()


def load_rules(path=None, spark: SparkSession | None = None):
    """Rules from a YAML file, the stock rules without a path; a missing file gives the built-in rules.

    With ``spark`` the path is read through Spark's file systems, else from this machine.
    """
    if path is None:
        return list(STOCK_RULES)
    import yaml

    if spark is None:
        text = Path(path).read_text("utf-8") if Path(path).exists() else None
    else:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()) if there else None
    if text is None:
        return built_in_rules()
    return [rule_from(e) for e in yaml.safe_load(text) or []]


def check_patterns(spark: SparkSession, rules):
    """Drop the patterns Spark cannot compile, with a warning for each."""
    checked = []
    for rule in rules:
        good = []
        for pattern in rule.patterns:
            try:
                spark.range(1).select(F.lit("").rlike(pattern)).collect()
                good.append(pattern)
            except Exception:
                warnings.warn(f"rule {rule.id}: pattern {pattern!r} is not valid and is left out")
        checked.append(Rule(**{**asdict(rule), "patterns": tuple(good)}))
    return checked


def add_rule(rules, rule):
    if any(r.id == rule.id for r in rules):
        raise ValueError(f"a rule {rule.id!r} exists already")
    return [*rules, rule]


def remove_rule(rules, rule_id):
    left = [r for r in rules if r.id != rule_id]
    if len(left) == len(rules):
        raise KeyError(rule_id)
    return left


RULE_SCHEMA = (
    "ord int, id string, name string, description string, severity string, tags array<string>, protocol string, "
    "src_ports array<int>, dst_ports array<int>, patterns array<string>, "
    "equals map<string,string>, metadata map<string,string>"
)


def rules_table(spark: SparkSession, rules):
    rows = [
        (i, r.id, r.name, r.description, r.severity, list(r.tags), r.protocol, list(r.src_ports),
         list(r.dst_ports), list(r.patterns), dict(r.equals), dict(r.metadata))
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)
