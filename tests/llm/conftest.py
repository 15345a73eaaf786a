from sievewright.llm import common

common.FREE_SHUFFLES = None  # small tables need no early freeing
