"""Table layouts (Spark DDL) and the fixed seed rows of the field catalogue.

``contract_id`` is shown as STRING; every operator also accepts BIGINT keys.
"""

from __future__ import annotations

BBOX = "STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>"

CONTRACTS = """contract_id STRING, title STRING, content_hash STRING, contract_type STRING,
  contract_type_confidence DOUBLE, status STRING, page_count INT, ocr_completed_at TIMESTAMP_NTZ,
  extraction_completed_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"""

CONTRACT_FILES = """id STRING, contract_id STRING, file_name STRING, file_path STRING, file_type STRING,
  file_size BIGINT, content_type STRING, version INT, created_at TIMESTAMP_NTZ"""

BLOCKS = f"""id STRING, contract_id STRING, page_no INT, block_type STRING, text STRING, confidence DOUBLE,
  bbox {BBOX}, sort_order INT, paragraph_id INT, font_size DOUBLE, page_width INT, page_height INT"""

FIELDS = f"""id STRING, contract_id STRING, field_key STRING, field_name STRING, value STRING,
  value_type STRING, source_text STRING, page_no INT, bbox {BBOX}, confidence DOUBLE, pos INT,
  review_status STRING, reviewed_value STRING, reviewer_id STRING, reviewed_at TIMESTAMP_NTZ"""

DEFINITIONS = """field_key STRING, field_name STRING, description STRING, value_type STRING,
  required BOOLEAN, sort_order INT, is_active BOOLEAN, contract_type STRING"""

VIOLATIONS = """contract_id STRING, rule_key STRING, severity STRING, message STRING, field_key STRING,
  rule_order INT, item_order INT"""

REVIEWS = """id STRING, contract_id STRING, target_type STRING, target_id STRING, action STRING,
  old_value STRING, new_value STRING, comment STRING, reviewer_id STRING, created_at TIMESTAMP_NTZ"""

OCR_RESPONSES = "contract_id STRING, page_no INT, provider STRING, body STRING"
MODEL_RESPONSES = "contract_id STRING, chunk_no INT, raw STRING, error STRING"
GOLDEN = "contract_id STRING, field_key STRING, expected STRING"

# The 23 default field definitions, in catalogue order
# (key, name, description). Only the two party names are required.
SEED_DEFINITIONS = [
    ("party-a-name", "甲方名称", "甲方名称"),
    ("party-a-legal-rep", "甲方法定代表人", "甲方法定代表人姓名"),
    ("party-a-agent", "甲方委托代理人", "甲方委托代理人姓名"),
    ("party-a-address", "甲方通讯地址", "甲方通讯地址"),
    ("party-a-bank", "甲方开户行", "甲方开户银行名称"),
    ("party-a-account", "甲方账号", "甲方银行账号"),
    ("party-a-tax", "甲方税号", "甲方纳税人识别号"),
    ("party-a-phone", "甲方电话", "甲方联系电话"),
    ("party-b-name", "乙方名称", "乙方名称"),
    ("party-b-legal-rep", "乙方法定代表人", "乙方法定代表人姓名"),
    ("party-b-agent", "乙方委托代理人", "乙方委托代理人姓名"),
    ("party-b-address", "乙方通讯地址", "乙方通讯地址"),
    ("party-b-bank", "乙方开户行", "乙方开户银行名称"),
    ("party-b-account", "乙方账号", "乙方银行账号"),
    ("party-b-tax", "乙方税号", "乙方纳税人识别号"),
    ("party-b-phone", "乙方电话", "乙方联系电话"),
    ("contract-amount", "合同金额", "合同总金额，包括币种和数额"),
    ("prepayment-amount", "预付款金额", "合同约定的预付款/首期款金额，优先提取具体金额数值，其次提取比例"),
    ("prepayment-ratio", "预付款比例", "预付款占合同总金额的比例"),
    ("payment-method", "付款方式", "合同约定的付款方式，如银行转账、支票等"),
    ("sign-date", "签署日期", "合同签署日期"),
    ("effective-date", "生效日期", "合同生效日期"),
    ("end-date", "终止日期", "合同终止日期或截止日期"),
]
REQUIRED_KEYS = ("party-a-name", "party-b-name")


def seed_rows() -> list[tuple]:
    """The default definitions as rows of ``DEFINITIONS``."""
    return [
        (key, name, desc, "string", key in REQUIRED_KEYS, order, True, None)
        for order, (key, name, desc) in enumerate(SEED_DEFINITIONS, start=1)
    ]


def seed_patches() -> list[tuple]:
    """The defaults as they are written over existing rows.

    NULL marks what a default leaves alone: the required flag of other keys
    than the two names, and the value type of the party fields.
    """
    return [
        (key, name, desc, "string" if order > 16 else None, True if key in REQUIRED_KEYS else None, order, True, None)
        for order, (key, name, desc) in enumerate(SEED_DEFINITIONS, start=1)
    ]
