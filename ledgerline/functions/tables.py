"""Word lists, codes, field names and patterns whose content is given by the trade documents themselves."""

from __future__ import annotations

# --- Fixed values -----------------------------------------------------------
TOLERANCE = "0.05"

HEADER_FIELDS = (
    "invoice_number", "invoice_date", "supplier_name", "supplier_address", "supplier_tax_id", "buyer_name", "buyer_address", "consignee_name", "consignee_address", "currency",
    "invoice_total", "net_realisable_amount", "tax_amount", "tax_rate", "payment_terms", "country_of_origin", "country_of_destination", "transit_country", "port_of_loading",
    "port_of_discharge", "export_type_status", "reward_scheme_claim", "state_code", "district_code", "ad_code", "iec_number", "total_packages", "gross_weight", "net_weight",
)
ITEM_FIELDS = (
    "item_ser_no", "product_description", "part_number", "model_or_type", "order_number", "hsn_code", "quantity", "unit_of_measurement", "unit_price", "line_total", "end_use_code",
    "fta_code", "country_of_origin", "igst_amount", "igst_rate", "packages",
)

# Columns of the two item sheets, in the templates' order.
EXPORT_SHEET, IMPORT_SHEET = "ITEM", "BOE"
ITEM_COLUMNS = (
    "Item_Ser_No", "Item_Scheme_Code", "Item_RITC", "Item_Desc", "Item_Unit1", "Item_Unit2", "PER", "Item_Qty", "Item_Unit_Price", "Item_JNoti_No", "item_Cess", "item_accessory",
    "item_thirdparty", "item_Quota", "item_AR4", "Item_Reward", "Item_STR", "Itm_Manu_codeType", "Accessory_status", "Itm_Manu_Code", "Itm_Manu_Add1", "Itm_Manu_Add2", "Itm_Manu_City",
    "Itm_Manu_Pin", "Itm_Manu_Cntry", "Itm_Manu_CntrySubDiv", "Itm_Source_Cntry", "Itm_Transit_Cntry", "ItmHawb", "ItmTotpkg", "ItmIGSTstatus", "ItmTaxableVal", "ItmIGSTamt", "Item_End_Use",
    "ItmIGSTPer", "Item_PMV", "Printed", "State Code", "District Code", "FTA Code", "CESS Per", "Cess Rate", "Cess Amount", "Qty Tariff", "Unit Tariff",
)
BOE_COLUMNS = (
    "SL_No", "Item_SchemeCode", "Item_RITC", "Item_Desc1", "Item_Gen_Desc", "Item_End_Use", "Item_Country_Org", "Item_Qty", "Item_Unit", "Item_Unit_Price", "Item_BCD_Ntfn",
    "Item_BCD_Ntfn_SLNo", "Item_CVD_Ntfn", "Item_CVD_Ntfn_SLNo", "GSIA_Ntfn", "GSIA_NTFN_SLNo", "SCH_II_Ntfn", "SCH_II_SLNo", "TTA_Ntfn", "TTA_Ntfn_SLNo", "Item_SWC_Ntfn",
    "Item_SWC_Ntfn_SlNo", "Item_CVD_Cess_Ntfn", "Item_CVD_Cess_Ntfn_SlNo", "Item_AddlCVD_Ntfn", "Item_AddlCVD_Ntfn_SlNo", "Accessory_status", "Itm_Manu_Code", "Itm_Manu_Add1",
    "Itm_Manu_Add2", "Itm_Manu_City", "Itm_Manu_Pin", "Itm_Manu_Cntry", "Itm_Manu_CntrySubDiv", "IGST_Levy_Ntfn_No", "IGST_Levy_Ntfn_Sl_No", "IGST_Exmp_Ntfn_No", "IGST_Exmp_Ntfn_Sl_No",
    "IGST_Cess_Levy_Ntfn_No", "IGST_Cess_Levy_Ntfn_Sl_No", "IGST_Cess_Exmp_Ntfn_No", "IGST_Cess_Exmp_Ntfn_Sl_No", "Item_SAPTA_Ntfn", "Item_SAPTA_Ntfn_SrNo", "Item_NCD_Ntfn",
    "Item_NCD_Ntfn_SlNo", "Item_Health_Ntfn", "Item_Health_Ntfn_SlNo", "Item_Agg_Ntfn", "Item_Agg_Ntfn_SlNo", "Item_Sfg_Ntfn", "Item_Sfg_Ntfn_SlNo", "IGST_Cus_Exemption_Ntfn_No",
    "IGST_Cus_Exemption_Ntfn_SlNo", "IGSTCESS_Cus_Exemption_Ntfn_No", "IGSTCESS_Cus_Exemption_Ntfn_SlNo", "Full Exemption Y/N", "Scheme_Ntfn", "Scheme_Ntfn_Sl_No", "Qty_Tariff",
    "Unit_Tariff", "Printed", "SIMS_Regn_No", "SIMS_Rgn_Date", "SIMS_Exp_Date", "SIMS_isReturnable", "Brand Name", "Model", "Manufacturer", "COO Certificate No", "Certificate Date",
    "COO Country", "Criteria Code", "Sub Criteria", "Cumulation", "Retroactive", "Direct Consignment", "Transit Country", "TariffShift", "Percentage", "ADIC Customs Notification", "SL No",
    "ADIC Excise Notification", "itm_HCusNtfnNo", "itm_HCusNtfnSlNo", "Item_Taxable_Val",
)
EMPTY_SHEETS = {
    "export": ("DRAWBACK", "License", "STR", "AR4", "ACCESSORY", "THIRDPARTY", "JOBWORK", "InfoType", "Constituent", "Production", "Control", "ReExport"),
    "import": ("InfoType", "Constituent", "Production", "Control", "License", "Section65", "ReImport"),
}
EXTRA_COLUMNS = ("part_number", "model_or_type", "order_number")
YES_NO_COLUMNS = ("item_Cess", "item_accessory", "item_thirdparty", "item_Quota", "item_AR4", "Item_Reward", "Item_STR", "Item_JNoti_No")

# Type hints by column name.
NUMBER_HINTS = ("qty", "price", "amt", "amount", "percentage", "value", "val", "rate", "duty", "pmv", "pkg", "taxable")
ALWAYS_STRING = (
    "item_cess", "item_accessory", "item_thirdparty", "item_quota", "item_ar4", "item_reward", "item_str", "item_jnoti_no", "per", "printed", "itm_source_cntry", "itm_transit_cntry",
    "itmigststatus", "item_end_use", "fta code", "state code", "district code", "cess per", "cess rate", "cess amount", "item_scheme_code", "itm_manu_codetype", "accessory_status",
    "item_ser_no", "sl_no",
)
ABBREVIATIONS = {
    "ser": "Serial", "no": "Number", "desc": "Description", "qty": "Quantity", "org": "Origin", "cntry": "Country", "manu": "Manufacturer", "add": "Address", "itm": "Item",
    "sl": "Serial", "ntfn": "Notification", "mfd": "Manufactured", "per": "Percentage", "val": "Value", "amt": "Amount", "regn": "Registration", "lic": "License",
}
LINK_COLUMNS = ("item_no", "item_ser_no", "sl_no")

# The column of each concept on either sheet.
CONCEPTS = {
    "export": {"ser_no": "Item_Ser_No", "quantity": "Item_Qty", "unit_price": "Item_Unit_Price", "line_amount": "ItmTaxableVal", "description": "Item_Desc", "hsn": "Item_RITC", "country_of_origin": "Itm_Source_Cntry", "unit": "Item_Unit1", "tariff_qty": "Qty Tariff", "tariff_unit": "Unit Tariff", "state_code": "State Code", "total_packages": "ItmTotpkg", "igst_rate": "ItmIGSTPer", "igst_amount": "ItmIGSTamt"},
    "import": {"ser_no": "SL_No", "quantity": "Item_Qty", "unit_price": "Item_Unit_Price", "line_amount": "Item_Taxable_Val", "description": "Item_Desc1", "hsn": "Item_RITC", "country_of_origin": "Item_Country_Org", "unit": "Item_Unit", "tariff_qty": "Qty_Tariff", "tariff_unit": "Unit_Tariff"},
}
REQUIRED_CONCEPTS = ("ser_no", "description", "quantity", "unit_price")

RETRYABLE = (
    "REQUIRED_FIELD_MISSING", "QTY_X_UNIT_PRICE", "TAX_RECONCILIATION", "PART_NUMBER_SOURCE_MATCH", "ORDER_NUMBER_SOURCE_MATCH", "MODEL_SOURCE_MATCH", "COUNTRY_OF_ORIGIN_CONSISTENCY",
    "FORMAT_TYPE", "MULTI_INVOICE_TOTAL_SPLIT", "LINE_ITEMS_INCOMPLETE", "HSN_FORMAT", "QTY_VS_TARIFF_QTY",
)
HEADER_RULES = ("HEADER_LINE_TOTAL", "MULTI_INVOICE_TOTAL_SPLIT")
ITEM_RULES = ("QTY_X_UNIT_PRICE", "TAX_RECONCILIATION", "PART_NUMBER_SOURCE_MATCH", "MODEL_SOURCE_MATCH", "ORDER_NUMBER_SOURCE_MATCH", "QTY_VS_TARIFF_QTY", "UNIT_VS_TARIFF_UNIT", "LINE_ITEMS_INCOMPLETE", "HSN_FORMAT")

CURRENCY_ALIASES = {
    "EURO": "EUR", "EUROS": "EUR", "€": "EUR", "US$": "USD", "USD$": "USD", "US DOLLAR": "USD", "US DOLLARS": "USD", "UNITED STATES DOLLAR": "USD", "UNITED STATES DOLLARS": "USD",
    "RS": "INR", "RUPEE": "INR", "RUPEES": "INR", "INDIAN RUPEE": "INR", "INDIAN RUPEES": "INR", "₹": "INR", "£": "GBP", "POUND STERLING": "GBP", "POUNDS STERLING": "GBP", "YEN": "JPY",
    "RMB": "CNY", "RENMINBI": "CNY", "YUAN": "CNY",
}
KNOWN_CURRENCIES = ("USD", "EUR", "GBP", "INR", "JPY", "CNY", "AUD", "CAD", "CHF", "SGD", "AED", "SAR", "HKD", "KRW", "SEK", "NOK", "DKK", "ZAR", "MXN", "BRL")
DATE_FORMATS = ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "M/d/yyyy", "d-MMM-yyyy", "d MMM yyyy", "d.M.yyyy", "yyyy/M/d")
SUMMARY_WORDS = ("TOTAL", "SUBTOTAL", "LESS", "NET REALISABLE", "FREE OF COST", "RAW MATERIAL")
NA_LIKE = ("NA", "N/A", "-", "NIL", "NONE", "")
PART_ALIASES = ("part_number", "part_no", "item_code", "drawing_no", "catalog_no")
MODEL_ALIASES = ("model_or_type", "type", "model", "type_no", "model_no")
RATING_ALIASES = ("ohms", "rating", "spec")

GSTIN = r"^\d{2}[A-Z]{5}\d{4}[A-Z][0-9A-Z]Z[A-Z0-9]$"
AD_CODE = r"^\d+-?\d+$"
CONTAINER = r"^[A-Z]{3}[UJZ]\d{6,7}$"
TARIFF_TAIL = r"(?is)^(.*?)\s+\d{4,8}[A-Z]\s+[A-Z][^\n]*$"
COMBINED = r"\s+/\s*|\s*/\s+"

PART_LABELS = (r"(?i)P\s*/\s*N\.?\s*[:\-]?\s*([A-Za-z0-9\-\./]{3,})", r"(?i)Part\s*No\.?\s*[:\-]\s*([A-Za-z0-9\-\./]{3,})")
MODEL_LABELS = (r"(?i)Model(?:\s*(?:No\.?|Number))?\s*[:\-]\s*([A-Za-z0-9\-\./]{2,})", r"(?i)\bType\s*[:\-]\s*([A-Za-z0-9\-\./]{2,})")
ORDER_LABELS = (r"(?i)P\s*/\s*O\.?\s*[:\-]?\s*([A-Za-z0-9\-]{3,})", r"(?i)(?:Purchase\s*)?Order\s*No\.?\s*[:\-]\s*([A-Za-z0-9\-]{3,})")

ADJUST_DOWN = r"(?i)\b(?:less|discount|rebate|deduction|deduct)\b"
ADJUST_UP = r"(?i)\b(?:add|freight|insurance|packing|packaging|handling|forwarding|charges?)\b"
ADJUST_AMOUNT = r"((?<![\d.,])\d[\d,]*\.\d{2}(?!\d)(?!\s*%))"
MAX_ADJUSTMENTS = 8

PAGE_MARKER = r"(?m)(?=^=+\s*PAGE\s+\d+\s+OF\s+\d+)"
OCR_PAGE_MARKER = r"(?m)(?=^--- Page \d+ \(OCR\) ---)"
QTY_HEADING, ITEM_HEADING = r"(?i)\b(?:qty|quantity|qnty)\b", r"(?i)\b(?:description|hsn|part\s*no|item)\b"
DATA_LINE = r"^\s*\d+\s*[│|]|\d[\d,]*\.\d{2,}|\b\d{6,}\b|\b\d{1,2}-[A-Za-z]{3}-\d{2,4}\b"
TRANSPORT = r"(?i)\bair\s*waybill\b|\bbill\s+of\s+lading\b"
TRANSPORT_FORM = r"(?i)shipper'?s\s+(?:name\s+and\s+address|account\s+number)|consignee'?s\s+(?:name\s+and\s+address|account\s+number)|nature\s+and\s+quantity\s+of\s+goods|notify\s+part(?:y|ies)"
NUMBER = r"((?<![\d.])\d[\d,]*(?:\.\d+)?(?!\d))"
MONEY = r"((?<![\d.,])\d[\d.,]*[.,]\d{2}(?!\d|[.,]\d))"
HSN_SPACED, HSN_PLAIN = r"((?<![\d.,/-])\d{4} \d{2}(?: \d{2})?(?![\d.,]))", r"((?<![\d.,/-])\d{8}(?![\d.,]))"
ROW_START, BLOCK_STOP = r"^\s*\d{1,3}\s*[│|]\s*\d{1,4}\b", r"(?i)^\s*(?:total|basic|grand|amount|=)"
CHARGE_ROW = r"^(?:(?:AIR|SEA|OCEAN|INLAND)\s+)?(?:FREIGHT|SHIPPING|INSURANCE|HANDLING|PACKING|PACKAGING|FORWARDING)(?:\s+(?:CHARGES?|COST|COSTS|FEES?))?$"
FOB_VALUE = r"f\.?\s*o\.?\s*b\.?\s*value(?:\s*\(?\s*(?:in\s+)?(?:inr|rs\.?|₹|usd|eur|gbp)\s*\)?)?\s*[:\-]?\s*(?:inr|rs\.?|₹)?\s*([\d,]+\.?\d*)"
RUPEES = r"\binr\b|\brs\b\.?|\brupees?\b|₹"
CARTONS = r"(?i)(\d[\d,]*)\s*(?:nos\.?)?\s*(?:cartons?|ctns?|cases?|boxes?|packages?|pkgs?|crates?|bags?|drums?)\b"

EXPORT_STRONG = ("shipping bill", "let export order", "export invoice", "drawback", "export tax invoice", "expwp", "expwop")
EXPORT_WEAK = ("rodtep", "meis", "egm")
IMPORT_STRONG = ("bill of entry", "boe no", "into bond", "warehouse bond", "import invoice", "customs duty payable", "import tax invoice")
IMPORT_WEAK = ("igm", "bcd", "cvd", "swc")
STRONG_POINTS, WEAK_POINTS, MARGIN = 3, 1, 3
BUYER_LABELS = ("customer", "buyer", "consignee", "bill to", "ship to", "sold to", "invoice address", "invoice to", "invoices address", "delivery address", "importer", "receiver")
SUPPLIER_LABELS = ("supplier", "seller", "exporter", "shipper", "sold by", "vendor", "manufacturer", "ship from")
ORIGIN_LABEL = r"country\s+of\s+origin(?:\s+of\s+\w+)?|exporter\s+country|country\s+of\s+loading(?:\s+of\s+\w+)?|country\s+of\s+export|port\s+of\s+loading|port\s+of\s+export"
DESTINATION_LABEL = r"country\s+of\s+(?:final\s+)?dest(?:ination)?\.?|port\s+of\s+discharge|final\s+destination|port\s+of\s+import"
REFERENCE_FIELD = r"\s*(?:'?s)?\s*(?:order|ref\w*|po\b|invoice|date)\b"
FORMAL_PREFIX = r"(?:republic\s+of|kingdom\s+of|state\s+of|sultanate\s+of|principality\s+of|united\s+states\s+of|people'?s\s+republic\s+of)\s*$"
COUNTRIES = (
    "india", "usa", "united states", "uk", "united kingdom", "germany", "singapore", "china", "maldives", "malaysia", "japan", "france", "italy", "spain", "netherlands", "belgium", "canada",
    "australia", "thailand", "vietnam", "indonesia", "korea", "taiwan", "mexico", "brazil", "switzerland", "uae", "saudi arabia", "hong kong", "south africa", "nigeria", "kenya", "egypt",
    "turkey", "russia", "poland", "sweden", "norway", "denmark", "finland", "austria", "portugal", "ireland", "greece", "israel", "qatar", "kuwait", "oman", "bangladesh", "sri lanka", "nepal",
    "pakistan", "myanmar", "philippines", "new zealand", "argentina", "chile", "colombia", "peru", "ukraine", "czech republic", "romania", "hungary",
)
HOME, NEAR_CHARS, SINGLE_LABEL_CHARS, REFERENCE_CHARS = "india", 900, 150, 20
COLUMN_MARK = "│"

# US dollars for a million tokens: (model, input, cached input, output); unknown models take the last row.
PRICES = (("gpt-5-nano", 0.05, 0.005, 0.40), ("gpt-4.1-nano", 0.10, 0.025, 0.40))
USD_TO_INR = 96.34
REASONING_MODELS = r"^(o1|o3|o4|gpt-5)"
# --- End of fixed values ----------------------------------------------------
