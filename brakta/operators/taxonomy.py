"""The label taxonomy and its dimension tables (all small and fixed, so literals)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The labels in taxonomy order, with their sensitivity tier.
LABELS = {
    "person": "direct",
    "email": "direct",
    "phone": "direct",
    "address": "direct",
    "personnummer": "direct",
    "organisationsnummer": "direct",
    "bank": "direct",
    "date": "contextual",
    "url": "contextual",
    "health": "art9_health",
    "religion_ethnicity": "art9_belief",
    "criminal": "art10_criminal",
    "card_number": "direct",
    "iban": "direct",
    "ip_address": "contextual",
    "username": "direct",
    "date_of_birth": "direct",
    "first_name": "direct",
    "last_name": "direct",
    "passport_number": "direct",
    "place_of_birth": "direct",
    "mrz": "direct",
}
# The labels a detector is conditioned on.
TRAINED = ("person", "email", "phone", "address", "personnummer", "organisationsnummer", "bank", "date", "url", "health", "religion_ethnicity", "criminal", "card_number", "iban", "ip_address", "username", "date_of_birth")
# Trained name -> key under which results are shown.
ALIASES = {"phone": "phone_number", "bank": "bank_account"}
# Key -> (colour, display label).
META = {
    "person": ("#ef4444", "Person"),
    "email": ("#f97316", "Email"),
    "phone_number": ("#f59e0b", "Phone"),
    "address": ("#84cc16", "Address"),
    "date_of_birth": ("#22c55e", "Date of birth"),
    "personnummer": ("#06b6d4", "Personnummer"),
    "organisationsnummer": ("#0ea5e9", "Organisationsnr"),
    "bank_account": ("#6366f1", "Bank account"),
    "iban": ("#8b5cf6", "IBAN"),
    "card_number": ("#a855f7", "Card"),
    "url": ("#ec4899", "URL"),
    "ip_address": ("#f43f5e", "IP"),
    "username": ("#64748b", "Username"),
    "health": ("#dc2626", "Health"),
    "religion_ethnicity": ("#7c3aed", "Religion / ethnicity"),
    "criminal": ("#b91c1c", "Criminal"),
    "date": ("#10b981", "Date"),
}
# Labels shown unless a user chooses others.
DEFAULT_ENABLED = ("person", "email", "phone_number", "address", "date_of_birth", "personnummer", "organisationsnummer", "bank_account", "iban", "card_number", "url", "ip_address", "username", "health", "religion_ethnicity")
# Default patterns a span's whole text must match.
DEFAULT_PATTERNS = {
    "email": r"^[\w.+-]+@[\w.-]+\.\w+$",
    "phone_number": r"^\+?\d[\d\s-]{6,}$",
    "personnummer": r"^\d{6,8}[-+]\d{4}$",
    "organisationsnummer": r"^\d{6}-\d{4}$",
    "bank_account": r"^\d{3,4}-\d{3,4}$",
    "iban": r"^[A-Z]{2}\d{2}[A-Z0-9]+$",
    "card_number": r"^(\d[ -]?){13,19}$",
    "ip_address": r"^(\d{1,3}\.){3}\d{1,3}$",
}
# Tier -> class of the sensitivity task, in output order.
CLASSES = {"direct": "direct_pii", "art9_health": "art9_health", "art9_belief": "art9_religion_ethnicity", "art10_criminal": "art10_criminal"}
NO_CLASS = "no_sensitive"
# A person's own identifiers, in output order.
IDENTIFIERS = ("personnummer", "email", "phone", "address")

UNCOVERED = set(LABELS.values()) - set(CLASSES) - {"contextual"}
if UNCOVERED:
    raise RuntimeError(f"tiers without a class: {UNCOVERED}")


def names_with(*tiers: str) -> list[str]:
    return [name for name, tier in LABELS.items() if tier in tiers]


def labels_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(LABELS.items())], "ord int, label string, tier string")


def meta_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, c, d) for k, (c, d) in META.items()], "label string, color string, display string")


def rules_table(spark: SparkSession) -> DataFrame:
    """Default rule of each key: pattern, mode, confidence floor, Luhn."""
    return spark.createDataFrame([(k, DEFAULT_PATTERNS.get(k, ""), "full", 0.0, False) for k in DEFAULT_ENABLED], "label string, regex string, mode string, threshold double, luhn boolean")
