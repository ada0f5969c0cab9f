"""Provinces and the default catalog: fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The provinces by plate code, 1 to 81.
PROVINCES = """Adana Adıyaman Afyonkarahisar Ağrı Amasya Ankara Antalya Artvin Aydın Balıkesir Bilecik Bingöl
Bitlis Bolu Burdur Bursa Çanakkale Çankırı Çorum Denizli Diyarbakır Edirne Elazığ Erzincan Erzurum Eskişehir
Gaziantep Giresun Gümüşhane Hakkari Hatay Isparta Mersin İstanbul İzmir Kars Kastamonu Kayseri Kırklareli
Kırşehir Kocaeli Konya Kütahya Malatya Manisa Kahramanmaraş Mardin Muğla Muş Nevşehir Niğde Ordu Rize Sakarya
Samsun Siirt Sinop Sivas Tekirdağ Tokat Trabzon Tunceli Şanlıurfa Uşak Van Yozgat Zonguldak Aksaray Bayburt
Karaman Kırıkkale Batman Şırnak Bartın Ardahan Iğdır Yalova Karabük Kilis Osmaniye Düzce""".split()

# Event types, their trigger words and their metrics.
DEAD = "vefat, hayatını kaybet, can kaybı, öldü, ölü"
HURT = "yaralı, yaralandı"
CATALOG_YAML = f"""
event-types:
- key: EPIDEMIC
  label: Salgın
  keywords: [salgın, pandemi, vaka, virüs, karantina, test]
  metrics:
  - {{key: NEW_CASE, label: Yeni vaka, keywords: [yeni vaka, vaka]}}
  - {{key: DEATH, label: Can kaybı, keywords: [{DEAD}]}}
  - {{key: RECOVERED, label: Taburcu, keywords: [taburcu, iyileşen, şifa buldu]}}
  - {{key: TEST, label: Yapılan test, keywords: [test]}}
- key: EARTHQUAKE
  label: Deprem
  keywords: [deprem, sarsıntı, artçı, enkaz, hasar]
  metrics:
  - {{key: DAMAGED_BUILDING, label: Hasarlı bina, keywords: [bina hasar, hasarlı bina, hasar gören bina, yıkılan bina]}}
  - {{key: DEATH, label: Can kaybı, keywords: [{DEAD}]}}
  - {{key: RESCUED, label: Kurtarılan, keywords: [kurtarıl, enkazdan çıkarıl, sağ kurtarıl]}}
  - {{key: INJURED, label: Yaralı, keywords: [{HURT}]}}
- key: TRAFFIC_ACCIDENT
  label: Trafik kazası
  keywords: [trafik kazası, kaza, çarpışma, devrilme]
  metrics:
  - {{key: ACCIDENT_COUNT, label: Kaza sayısı, keywords: [trafik kazası, kaza]}}
  - {{key: DEATH, label: Can kaybı, keywords: [{DEAD}]}}
  - {{key: INJURED, label: Yaralı, keywords: [{HURT}]}}
- key: FLOOD
  label: Sel
  keywords: [sel, su baskını, taşkın]
  metrics:
  - {{key: DEATH, label: Can kaybı, keywords: [{DEAD}]}}
  - {{key: INJURED, label: Yaralı, keywords: [{HURT}]}}
  - {{key: EVACUATED, label: Tahliye edilen, keywords: [tahliye]}}
  - {{key: AFFECTED_BUILDING, label: Etkilenen bina, keywords: [su basan, etkilenen bina, zarar gören bina]}}
- key: FIRE
  label: Yangın
  keywords: [yangın, alev, itfaiye]
  metrics:
  - {{key: DEATH, label: Can kaybı, keywords: [{DEAD}]}}
  - {{key: INJURED, label: Yaralı, keywords: [{HURT}]}}
  - {{key: EVACUATED, label: Tahliye edilen, keywords: [tahliye]}}
  - {{key: AFFECTED_BUILDING, label: Etkilenen bina, keywords: [etkilenen bina, zarar gören bina, kül olan]}}
"""


def provinces(spark: SparkSession) -> DataFrame:
    """code and name of the 81 provinces, as literal rows: Spark knows their size and broadcasts them."""
    rows = ", ".join(f"({k}S, '{name}')" for k, name in enumerate(PROVINCES, 1))
    return spark.sql(f"select * from values {rows} as p(code, name)")
