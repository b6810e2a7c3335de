"""Normalisation rules: plain values that are compiled into Column expressions on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

# Field aliases, keywords, defaults and patterns of the payload format.
FIELD_ALIASES = {
    "vendor_name": [
        "vendor_name", "vendor", "vendor.name", "merchant_name", "merchant", "seller",
        "supplier_name", "from.name", "company_name",
    ],
    "vendor_tax_id": [
        "vendor_tax_id", "tax_id", "vat_id", "bin", "supplier_tax_id", "gstin",
        "bill_from.tax_id", "vendor.tax_id",
    ],
    "invoice_number": [
        "invoice_number", "invoice_id", "order_id", "receipt_number", "reference_number",
        "invoice_no", "bill_no", "receipt_no", "document_number",
    ],
    "invoice_date": [
        "invoice_date", "order_date", "invoice_created_at", "date", "payment_date", "date_paid",
        "issued_date", "bill_date", "transaction_date",
    ],
    "due_date": ["due_date", "payment_due_date", "due_on"],
    "currency": ["currency", "currency_code", "invoice_currency"],
    "subtotal_amount": ["subtotal", "sub_total", "amount_before_tax", "net_amount", "item_total"],
    "tax_amount": ["tax_amount", "tax", "vat", "gst", "sales_tax", "tax_total"],
    "total_amount": [
        "total_amount", "total", "order_total", "grand_total", "amount_paid", "amount_due",
        "invoice_total", "total_due",
    ],
    "payment_method": ["payment_method", "payment_mode", "paid_via", "method", "payment_history.method"],
    "line_items": ["line_items", "items", "products", "details", "charges", "invoice_lines"],
    "model_confidence": ["model_confidence", "confidence", "confidence_score", "extraction_confidence"],
}
ITEM_ALIASES = {
    "description": ["description", "name", "title", "item", "product_name", "service_name"],
    "quantity": ["quantity", "qty", "count", "units"],
    "unit_price": ["unit_price", "price", "rate", "unit_cost"],
    "line_total": ["line_total", "total", "amount", "line_amount", "extended_price"],
    "category": ["category"],
}
PAYMENT_KEYWORDS = {
    "card": ["card", "visa", "mastercard", "amex", "credit", "debit"],
    "cash": ["cash", "cod", "cash on delivery"],
    "bank": ["bank", "transfer", "wire", "ach", "sepa", "swift"],
}
IGNORED_LINE_KEYWORDS = [
    "subtotal", "total", "grand total", "amount paid", "amount due", "balance", "tax", "vat", "gst",
    "discount", "shipping", "delivery", "payment method", "payment history", "invoice number",
    "receipt number", "date paid",
]

# The older dialect's aliases and keywords.
OCR_FIELD_ALIASES = {
    "vendor_name": ["vendor_name", "vendor", "merchant_name"],
    "vendor_tax_id": ["vendor_tax_id", "tax_id", "vat_id"],
    "invoice_number": ["invoice_number", "order_id", "invoice_id"],
    "invoice_date": ["invoice_date", "order_date", "date"],
    "due_date": ["due_date"],
    "currency": ["currency", "currency_code", "currency_symbol"],
    "subtotal_amount": ["subtotal", "sub_total"],
    "tax_amount": ["tax_amount", "tax", "vat"],
    "total_amount": ["total_amount", "total", "order_total", "grand_total"],
    "payment_method": ["payment_method"],
    "line_items": ["line_items", "items", "products"],
    "model_confidence": ["model_confidence", "confidence", "confidence_score"],
}
OCR_ITEM_ALIASES = {
    "description": ["description", "name", "title"],
    "quantity": ["quantity", "qty"],
    "unit_price": ["unit_price", "price"],
    "line_total": ["line_total", "total"],
    "category": ["category"],
}
OCR_PAYMENT_KEYWORDS = {"card": ["card"], "cash": ["cash"], "bank": ["bank", "transfer"]}

# Currency names and the ordered text markers of the older dialect.
CURRENCY_NAMES = {
    "USD": "USD", "US$": "USD", "$": "USD", "DOLLAR": "USD", "DOLLARS": "USD",
    "EUR": "EUR", "EURO": "EUR", "EUROS": "EUR", "€": "EUR",
    "GBP": "GBP", "POUND": "GBP", "POUNDS": "GBP", "£": "GBP",
    "BDT": "BDT", "TK": "BDT", "TAKA": "BDT", "৳": "BDT",
    "INR": "INR", "RS": "INR", "₹": "INR",
}
CURRENCY_MARKERS = [
    ("USD", [r"\bUSD\b", r"\bUS\$\b", r"(?<![A-Z])\$(?=\s*\d)", r"\bDOLLARS?\b"]),
    ("EUR", [r"\bEUR\b", "€", r"\bEUROS?\b"]),
    ("GBP", [r"\bGBP\b", "£", r"\bPOUNDS?\b"]),
    ("BDT", [r"\bBDT\b", "৳", r"\bTAKA\b", r"(?<![A-Z])TK(?=\s*[\d.])"]),
    ("INR", [r"\bINR\b", "₹", r"\bRUPEES?\b"]),
]

# Vendor names and category keywords, first match wins.
VENDOR_NAMES = {
    "walmart": "Walmart",
    "wal-mart": "Walmart",
    "wm supercenter": "Walmart",
    "amazon": "Amazon",
    "amzn": "Amazon",
    "starbucks": "Starbucks",
}
CATEGORY_KEYWORDS = {
    "office_supplies": ["paper", "printer", "ink", "stationery"],
    "travel": ["uber", "lyft", "taxi", "flight", "hotel"],
    "food_beverage": ["coffee", "restaurant", "cafe", "meal", "lunch"],
    "software": ["subscription", "license", "cloud", "saas"],
}

# Document states and the transitions allowed from each.
TRANSITIONS = {
    "NEW": ["CLAIMED", "FAILED"],
    "CLAIMED": ["EXTRACTED", "FAILED"],
    "EXTRACTED": ["VALIDATED", "REVIEW_REQUIRED", "FAILED"],
    "VALIDATED": ["STORED", "REVIEW_REQUIRED", "FAILED"],
    "REVIEW_REQUIRED": ["CLAIMED", "FAILED"],
    "STORED": ["ARCHIVED", "FAILED"],
    "ARCHIVED": [],
    "FAILED": [],
}

PROVIDER_ORDER = ["mistral", "openrouter", "groq"]
ALLOWED_MIME = ["image/jpeg", "image/png", "application/pdf"]
AMOUNT_TOLERANCE = 0.01
DECISION_THRESHOLD = 0.85
REVIEW_THRESHOLD = 0.5
STORE_REVIEW_SCORE = 0.6


@dataclass(frozen=True)
class Rules:
    """One normaliser dialect."""

    field_aliases: dict[str, list[str]] = field(default_factory=lambda: FIELD_ALIASES)
    item_aliases: dict[str, list[str]] = field(default_factory=lambda: ITEM_ALIASES)
    payment_keywords: dict[str, list[str]] = field(default_factory=lambda: PAYMENT_KEYWORDS)
    ignored_lines: list[str] = field(default_factory=lambda: IGNORED_LINE_KEYWORDS)
    default_currency: str = "BDT"
    default_document_type: str = "invoice"
    default_confidence: float = 0.8
    amount_tolerance: float = AMOUNT_TOLERANCE
    clean_money: bool = True
    month_names: bool = True
    infer_currency: bool = False
    vendor_objects: bool = True
    strict_ocr_lines: bool = True
    reconcile: bool = True

    def aliases(self, name: str) -> list[str]:
        return self.field_aliases.get(name, [name])

    def item(self, name: str) -> list[str]:
        return self.item_aliases.get(name, [name])


RULES = Rules()
OCR_DIALECT = Rules(
    field_aliases=OCR_FIELD_ALIASES,
    item_aliases=OCR_ITEM_ALIASES,
    payment_keywords=OCR_PAYMENT_KEYWORDS,
    ignored_lines=[],
    clean_money=False,
    month_names=False,
    infer_currency=True,
    vendor_objects=False,
    strict_ocr_lines=False,
    reconcile=False,
)


def load_rules(text: str) -> Rules:
    """Rules from the text of a JSON rules file; absent parts mean empty lists or the defaults."""
    data = json.loads(text)
    return Rules(
        field_aliases=data.get("field_aliases", {}),
        item_aliases=data.get("line_item_aliases", {}),
        payment_keywords=data.get("payment_method_map", {}),
        ignored_lines=[str(word).lower() for word in data.get("line_item_ignore_keywords", [])],
        default_currency=str(data.get("default_currency", "BDT")).upper(),
        default_document_type=str(data.get("default_document_type", "invoice")).lower(),
        default_confidence=float(data.get("default_confidence", 0.8)),
        amount_tolerance=float(data.get("amount_tolerance", AMOUNT_TOLERANCE)),
    )
