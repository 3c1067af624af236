"""Text and name functions over source code, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgrain.hashing import h60

# Words that count as one structural token.
TOKEN_FAMILIES = {
    "loop": ["while", "for", "loop", "do"],
    "branch": ["if", "switch", "match"],
    "catch": ["catch", "except", "rescue", "recover"],
    "async_op": ["async", "await", "yield", "suspend"],
    "exit": ["return", "break", "continue", "throw", "raise"],
}
# Parts of a name that speak of a secret, and names of validators.
SECRET_PARTS = (
    "key secret token password passwd pwd apikey api_key auth credential cred cert private priv signing encryption webhook hmac bearer oauth jwt salt seed nonce passphrase pin otp"
).split()
PERSONAL_NAMES = (
    "email emailaddress email_address useremail phone phonenumber phone_number mobile mobilenumber cell password passwordhash password_hash hashedpassword hashed_password passworddigest "
    "apikey api_key secretkey secret_key accesstoken access_token refreshtoken refresh_token privatekey private_key ssn socialsecuritynumber social_security_number taxid tax_id nin tfn "
    "passportnumber passport_number driverlicense driver_license licensenumber creditcard credit_card cardnumber card_number pan cvv cvc expirydate dateofbirth date_of_birth dob birthdate "
    "birth_date address streetaddress street_address homeaddress billingaddress shippingaddress ipaddress ip_address userip user_ip clientip client_ip medicalrecord medical_record diagnosis "
    "healthcondition health_condition prescription bankaccount bank_account accountnumber account_number routingnumber routing_number iban swift"
).split()
VALIDATOR = r"^(validate|check_|verify_|ensure_|sanitize_|parse_|guard_)|_validator|_verifier"
BLOCK = r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
KEYWORDS_PRESENT = "if else for while loop match switch try catch throw return await async yield break continue new unsafe fn function class import".split()


def tokens(body: Column) -> Column:
    """Whitespace tokens without those that start a line comment; a null body has none."""
    parts = F.split(F.coalesce(body, F.lit("")), r"[ \t\n\r]+")
    return F.filter(parts, lambda t: (t != "") & ~t.startswith("//"))


def normalized_tokens(body: Column) -> Column:
    """Tokens with each family of control words replaced by its name."""

    def family(t: Column) -> Column:
        out = None
        for name, words in TOKEN_FAMILIES.items():
            out = (F.when if out is None else out.when)(t.isin(words), F.lit(name))
        return out.otherwise(t)

    return F.transform(tokens(body), family)


def ngram_hashes(toks: Column, n: int) -> Column:
    """Sorted distinct hashes of all windows of ``n`` tokens; fewer tokens than ``n`` give none."""
    count = F.size(toks) - (n - 1)
    starts = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.array_distinct(F.transform(starts, lambda i: h60(F.concat_ws(" ", F.slice(toks, i, n))))))


def positional_ngram_hashes(toks: Column, n: int) -> Column:
    """As :func:`ngram_hashes`, with the window's place (in 1024 steps from first to last) mixed in."""
    count = F.size(toks) - (n - 1)
    starts = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda i: F.floor(i * 1024 / F.greatest(count - 1, F.lit(1))).cast("long")
    return F.sort_array(F.array_distinct(F.transform(starts, lambda i: h60(F.concat_ws(" ", F.slice(toks, i + 1, n), place(i).cast("string"))))))


def name_segments(name: Column) -> Column:
    """Parts of a name, split at underscores and before capital letters."""
    parts = F.split(F.regexp_replace(F.coalesce(name, F.lit("")), r"([A-Z])", "_$1"), "_")
    return F.filter(parts, lambda p: p != "")


def last_segment(path: Column) -> Column:
    """What follows the last dot or colon."""
    return F.regexp_extract(path, r"([^.:]*)$", 1)


def category_of(rule_id: Column, default: str = "unknown") -> Column:
    """The second underscore-separated part of an identifier."""
    return F.coalesce(F.nullif(F.try_element_at(F.split(rule_id, "_"), F.lit(2)), F.lit("")), F.lit(default))


def directory_prefix(path: Column, depth: int = 3) -> Column:
    """The deepest ``depth`` directories above a file."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return F.array_join(F.slice(folders, F.greatest(F.size(folders) - (depth - 1), F.lit(1)), depth), "/")


def strip_comments_and_strings(body: Column) -> Column:
    """Code without comments and with empty string literals: one alternation, leftmost match wins."""
    # loops unrolled: the engine recurses per repeated group, so only escapes and stars may repeat one
    kept = r'("[^"\\\n]*(?:\\.[^"\\\n]*)*"|\'[^\'\\\n]*(?:\\.[^\'\\\n]*)*\')|//[^\n]*|' + BLOCK
    return F.regexp_replace(body, kept, "")


def call_targets(code: Column) -> Column:
    """Distinct full names directly before an opening parenthesis."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(r"([A-Za-z_$][A-Za-z0-9_$.:]*)\("), 1)))


def keywords_present(code: Column) -> Column:
    words = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(r"([A-Za-z_]+)"), 1)
    return F.sort_array(F.array_intersect(F.array(*[F.lit(k) for k in KEYWORDS_PRESENT]), words))


def comment_density(body: Column) -> Column:
    """Comment characters over all characters; 0 for an empty body."""
    comments = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(//[^\n]*|" + BLOCK + ")"), 1)
    size = F.aggregate(comments, F.lit(0), lambda s, c: s + F.length(c))
    return F.coalesce(F.try_divide(size, F.length(body)), F.lit(0.0))


def shannon_entropy(text: Column) -> Column:
    """Entropy in bits per character (of all characters, not ASCII bytes alone); 0 for an empty text."""
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    distinct = F.array_distinct(chars)

    def part(c: Column) -> Column:
        p = F.size(F.filter(chars, lambda x: x == c)) / n
        return -p * F.log2(p)

    return F.when(n == 0, 0.0).otherwise(F.aggregate(distinct, F.lit(0.0), lambda s, c: s + part(c)))


def names_a_secret(name: Column) -> Column:
    return F.lower(name).rlike("|".join(SECRET_PARTS))


def is_personal_name(name: Column) -> Column:
    return F.lower(name).isin(PERSONAL_NAMES)


def names_a_validator(name: Column) -> Column:
    return F.lower(name).rlike(VALIDATOR)


def file_safe(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{{name}}``, ``${name}``, ``{name}`` and ``<name>`` by the value of each name."""
    out = template
    for name, value in values.items():
        for spelling in ("{{%s}}", "${%s}", "{%s}", "<%s>"):
            out = F.replace(out, F.lit(spelling % name), F.coalesce(value.cast("string"), F.lit("")))
    return out


def import_packages(content: Column) -> Column:
    """Packages that a script imports or requires, distinct."""
    es = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"""from\s+['"]([^'"]+)['"]"""), 1)
    cjs = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"""require\(\s*['"]([^'"]+)['"]\s*\)"""), 1)
    return F.sort_array(F.array_distinct(F.concat(es, cjs)))


def glob_pattern(glob: str) -> str:
    """The regular expression of a path glob: ``**`` crosses folders, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".^$+{}()|[]\\" else c
            i += 1
    return f"^{out}$"


def base_type_name(annotation: Column) -> Column:
    """The bare name of a type annotation: no colon, reference, generics or qualifying parts."""
    bare = F.regexp_replace(F.regexp_replace(annotation, r"^\s*:?\s*(?:&\s*)?(?:mut\s+)?", ""), r"[<\[|?].*$", "")
    return F.trim(F.regexp_extract(bare, r"([A-Za-z_$][\w$]*)\s*$", 1))


def injection_points(content: Column) -> Column:
    """Distinct ``place.name`` of the request fields that a handler reads, such as ``query.id``."""
    fields = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"\b(?:req|request|ctx|c\.req)\.((?:body|query|params|headers|cookies)\.[A-Za-z_$][\w$]*)"), 1)
    return F.sort_array(F.array_distinct(fields))


def form_token(html: Column) -> Column:
    """The value of a hidden anti-forgery field or meta tag; null where there is none."""
    names = r"(?:_?csrf(?:[_-]?token)?|authenticity_token|__RequestVerificationToken|xsrf-token)"
    field = F.regexp_extract(html, r"(?i)<(?:input|meta)\b[^>]*\bname=[\"']" + names + r"[\"'][^>]*\b(?:value|content)=[\"']([^\"']*)[\"']", 1)
    turned = F.regexp_extract(html, r"(?i)<(?:input|meta)\b[^>]*\b(?:value|content)=[\"']([^\"']*)[\"'][^>]*\bname=[\"']" + names + r"[\"']", 1)
    return F.nullif(F.when(field != "", field).otherwise(turned), F.lit(""))
