"""Schemas of the inputs and of the records passed between operators."""

from __future__ import annotations

MONEY = "decimal(18,2)"

INVOICE = (
    "row_idx bigint, nomor_faktur string, tanggal date, npwp_penjual string, nama_penjual string, npwp_pembeli string, "
    "nama_pembeli string, dpp decimal(18,2), ppn decimal(18,2), total decimal(18,2), nama_barang string, quantity string"
)
SLIP = (
    "row_idx bigint, nomor_bukti_potong string, tanggal date, npwp_pemotong string, nama_pemotong string, npwp_dipotong string, "
    "nama_dipotong string, jenis_penghasilan string, bruto decimal(18,2), tarif decimal(18,2), pph decimal(18,2)"
)
BANK_ROW = (
    "row_idx bigint, account_number string, tanggal date, keterangan string, cabang string, referensi string, "
    "debet decimal(18,2), kredit decimal(18,2), saldo decimal(18,2)"
)
MATCH_CANDIDATE = (
    "source_type string, source_file string, source_row int, date string, amount decimal(18,2), vendor_name string, "
    "reference string, raw_data map<string,string>"
)

# Headers a sheet of each kind must have.
REQUIRED = {
    "faktur_pajak": [
        "Nomor Faktur", "Tanggal Faktur", "NPWP Penjual", "Nama Penjual", "NPWP Pembeli", "Nama Pembeli",
        "DPP (Rp)", "PPN (Rp)", "Total (Rp)",
    ],
    "bukti_potong": [
        "Nomor Bukti Potong", "Tanggal Bukti Potong", "NPWP Pemotong", "Nama Pemotong",
        "Jumlah Penghasilan Bruto (Rp)", "PPh Dipotong (Rp)",
    ],
    "rekening_koran": ["Tanggal", "Keterangan", "Debet (Rp)", "Kredit (Rp)"],
}
