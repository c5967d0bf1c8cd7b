"""Tax-invoice, withholding-slip and bank-ledger reconciliation on Spark DataFrames."""
