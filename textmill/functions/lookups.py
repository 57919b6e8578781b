"""Code to label tables, joined as small dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Forum modules, products and ticket states by code.
FORUM_MODULES = {
    "12": "Neue Versionen",
    "15": "SelectLine Auftrag",
    "16": "SelectLine Lohn",
    "17": "V17 USTVADAT keine Anzeige - Lösung",
    "18": "SelectLine Mobile",
    "19": "Plantafel",
    "20": "Programmübergreifend",
    "24": "Installation / Updates",
    "25": "Updates",
    "26": "SQL Server",
    "27": "Abkündigung SQL Server 2008 R2 und Windows Vi",
    "29": "PC-Kasse",
    "34": "Lagerverwaltung",
    "36": "SelectLine Auftrag Allgemein",
    "45": "SelectLine Rechnungswesen / Fibu Allgemein",
    "49": "Kostenrechnung",
    "50": "SQL Server",
    "54": "Verbuchung der Bezugsteuer",
    "56": "ELM: EIV-Upload der XML-Datei per Internet",
    "57": "Skip5",
    "59": "Allgemeine Forum Regel für die Registrierung",
    "68": "Makros",
    "69": "Toolbox & COM",
    "70": "CRM",
    "72": "Off-Topics - Partner-Lösungen",
    "74": "SelectLine stellt sich vor - Rundgang durch's",
    "76": "Off-Topics - Partner-Lösungen",
    "77": "Fremdwährungen im Kassabuch",
    "78": "Programm Einrichtung",
    "79": "Einrichtung Lohn",
    "80": "OPOS EZV Rechnungswesen",
    "81": "Toolbox",
    "82": "SelectLine News",
    "83": "MDE",
    "84": "Doqio",
    "85": "SelectLine Server",
}
PRODUCTS = {
    "1": "Auftrag",
    "2": "Rechnungswesen",
    "3": "Lohn",
    "4": "Kassabuch",
    "5": "Leistung",
    "6": "PC Kasse",
    "7": "Vertriebsmodul",
    "8": "Datenorm/Artikelmanager",
    "9": "WAG Auftrag",
    "10": "WAG Fibu",
    "11": "WAG Lohn",
    "12": "Toolbox",
    "13": "Systemübergreifend",
    "14": "Anlagebuchhaltung",
    "15": "OP-Verwaltung",
    "16": "Helpdesk",
    "17": "Internetauftritt",
    "18": "Verkauf",
    "19": "Mapkit",
    "20": "CRM",
    "21": "SL.mobile",
    "22": "Plantafel",
    "23": "/",
    "24": "Makro SQL",
    "25": "Power BI",
    "26": "SL.MDE",
    "27": "SL.Archiv",
    "28": "SelectLine Server",
}
TICKET_STATES = {
    "1": "Aufgenommen",
    "7": "Zu Bearbeiten",
    "8": "Zu Testen",
    "12": "SLDE",
    "13": "Zu Besprechen",
    "17": "Abgebrochen",
    "21": "Wiedereröffnet",
    "1000": "Erledigt",
}


def resolve(df: DataFrame, code: str, label: str, table: dict[str, str]) -> DataFrame:
    """Adds ``label``: the code's label, or the code itself if it has none.

    The table is a constant of this module, so its broadcast is bounded.
    """
    dim = df.sparkSession.createDataFrame(list(table.items()), "_code string, _label string")
    return df.join(F.broadcast(dim), df[code] == dim["_code"], "left").withColumn(label, F.coalesce("_label", F.col(code))).drop("_code", "_label")
