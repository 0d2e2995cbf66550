"""For each rule a text it finds a value in, and a near miss that it doesn't: planted behind documents, a query shows both."""

from __future__ import annotations

#: rule: (text, value found in it, near miss).  Values are invented; key formats are put together here.
_A, _K = "a1B2", "ABCD1234"
CASES: dict[str, tuple[str, str, str]] = {
    "universal.EMAIL.1": ("to ann@example.com now", "ann@example.com", "to ann@localhost now"),
    "universal.EMAIL.2": ("to ann @ example.com now", "ann @ example.com", "to ann  @ example.com now"),
    "universal.PHONE.1": ("call +44 20 7946 0958", "+44 20 7946 0958", "call 44 20 7946 0958"),
    "universal.CREDIT_CARD.1": ("card 4111 1111 1111 1111.", "4111 1111 1111 1111", "card 4111 1111 1111 1112."),
    "universal.API_KEY.1": ("key sk-" + _A * 6, "sk-" + _A * 6, "key sk-" + _A * 4),
    "universal.API_KEY.2": ("key sk-proj-" + _A * 6, "sk-proj-" + _A * 6, "key sk-PROJ-" + _A * 6),
    "universal.API_KEY.3": ("id AKIA" + _K * 2, "AKIA" + _K * 2, "id xAKIA" + _K * 2),
    "universal.API_KEY.4": ("key AIza" + "Ab1-_" * 7, "AIza" + "Ab1-_" * 7, "key AIza" + "Ab1-_" * 6),
    "universal.ACCESS_TOKEN.1": ("use ghp_" + "a1" * 18, "ghp_" + "a1" * 18, "use ghx_" + "a1" * 18),
    "universal.ACCESS_TOKEN.2": ("use github_pat_" + "a1_B" * 6, "github_pat_" + "a1_B" * 6, "use github_pat_" + "a1_B" * 5),
    "universal.ACCESS_TOKEN.3": ("use xoxb-" + "1a" * 6, "xoxb-" + "1a" * 6, "use xoxz-" + "1a" * 6),
    "universal.ACCESS_TOKEN.4": ("jwt eyJ" + "aB3_" * 3 + ".eyJ" + "cD4-" * 3 + "." + "eF5_" * 3, "eyJ" + "aB3_" * 3 + ".eyJ" + "cD4-" * 3 + "." + "eF5_" * 3, "jwt eyJ" + "aB3_" * 3 + ".xyz" + "cD4-" * 3 + "." + "eF5_" * 3),
    "universal.PRIVATE_KEY.1": ("-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----\nabc"),
    "universal.DATABASE_URL.1": ("at postgres://u:p@db.local/x", "postgres://u:p@db.local/x", "at xpostgres://u:p@db.local/x"),
    "universal.PASSWORD.1": ('password: "Tr0ub4dor"', "Tr0ub4dor", "passwords: Tr0ub4dor"),
    "universal.PASSWORD.2": ("the password is hunter2A", "hunter2A", "the password is wrong"),
    "universal.PASSWORD.3": ("パスワードはHunter2Aです", "Hunter2A", "パスワードはひみつです"),
    "universal.PASSWORD.4": ("密码是Hunter2A，", "Hunter2A", "密码是abcd，"),
    "universal.INTERNAL_URL.1": ("see https://wiki.corp/x", "https://wiki.corp/x", "see https://example.com/x"),
    "universal.INTERNAL_IP.1": ("at 10.0.0.7.", "10.0.0.7", "at 8.8.8.8."),
    "universal.PERSON.1": ("in /home/ann/x", "ann", "in /home/root/x"),
    "universal.EMPLOYEE_ID.1": ('{"employee_id": "E-77"}', "E-77", '{"employees_id": "E-77"}'),
    "universal.POSTAL_CODE.1": ('{"postcode": "X1 1XX"}', "X1 1XX", '{"postcodes": "X1 1XX"}'),
    "universal.PHONE.2": ('{"mobile": "55501"}', "55501", '{"immobile": "55501"}'),
    "universal.ADDRESS.1": ('{"street_address": "1 Way"}', "1 Way", '{"ip_address": "1 Way"}'),
    "universal.PERSON.2": ('{"fullName": "Al Doe"}', "Al Doe", '{"fileName": "Al Doe"}'),
    "universal.PERSON.3": ('{"lastName": "Doe"}', "Doe", '{"pastName": "Doe"}'),
    "universal.COMPANY_NAME.1": ('{"employer": "Acme"}', "Acme", '{"employers": "Acme"}'),
    "universal.DATE_OF_BIRTH.1": ('{"dob": "1990-02-03"}', "1990-02-03", '{"dot": "1990-02-03"}'),
    "universal.API_KEY.5": ("run " + _A * 9, _A * 9, "run " + "a1b2" * 9),
    "universal.IDENTIFIER.1": ("ticket AB-12345 open", "AB-12345", "see RFC-2606 open"),
    "universal.IDENTIFIER.2": ("no 123456789 there", "123456789", "no 1234567 there"),
    "universal.PHONE.3": ("tel 090-1234-5678.", "090-1234-5678", "tel 060-1234-5678."),
    "universal.PHONE.4": ("tel 138 1234 5678.", "138 1234 5678", "tel 128 1234 5678."),
    "en.PHONE.1": ("call (212) 555-0142.", "(212) 555-0142", "call (112) 555-0142."),
    "en.PHONE.2": ("call 01632 960 123.", "01632 960 123", "call 00632 960 123."),
    "en.SSN.1": ("id 219-09-9998.", "219-09-9998", "id 000-09-9998."),
    "en.SSN.2": ("SSN: 219 09 9998", "219 09 9998", "SSN: 219 00 9998"),
    "en.POSTAL_CODE.1": ("zip 12345-6789.", "12345-6789", "zip 12345-678."),
    "en.POSTAL_CODE.2": ("zip code: 12345", "12345", "zip code: 1234"),
    "en.POSTAL_CODE.3": ("at SW1A 1AA.", "SW1A 1AA", "at SW1A 1AAA."),
    "en.DATE_OF_BIRTH.1": ("DOB: 1990-02-03", "1990-02-03", "DOA: 1990-02-03"),
    "en.ADDRESS.1": ("at 12 Long Oak Street, town", "12 Long Oak Street", "at 12 long oak street, town"),
    "en.COMPANY_NAME.1": ("with Acme Widgets Ltd today", "Acme Widgets Ltd", "The Same Old Ltd today"),
    "en.EMPLOYEE_ID.1": ("Employee ID: E-1042", "E-1042", "Employer ID: E-1042"),
    "en.PROJECT_NAME.1": ("in Project Falcon we", "Falcon", "in Project falcon we"),
    "en.PROJECT_NAME.2": ("project name: Blue Heron", "Blue Heron", "project names: Blue Heron"),
    "en.PERSON.1": ("met Dr. Ann Lee there", "Ann Lee", "met Dt. Ann there"),
    "en.PERSON.2": ("Dear Ann Lee,", "Ann Lee", "Dear Ann Lee!"),
    "en.PERSON.3": ("Regards,\nAnn Lee", "Ann Lee", "Regards,\nann lee"),
    "en.PERSON.4": ("Assignee: Ann Lee", "Ann Lee", "Assignee: Project Team"),
    "en.PERSON.5": ("so Ann Lee went", "Ann Lee", "so Monday March went"),
    "en.PHONE.3": ("no 2125550142 there", "2125550142", "no 1125550142 there"),
    "en.SSN.3": ("no 219099998 there", "219099998", "no 666099998 there"),
    "en.POSTAL_CODE.4": ("in CA 94016 there", "94016", "in Ca 94016 there"),
    "ja.PHONE.1": ("電話 03-1234-5678 まで", "03-1234-5678", "電話 13-1234-5678 まで"),
    "ja.POSTAL_CODE.1": ("〒100-0001 東京", "100-0001", "番100-0001 東京"),
    "ja.ADDRESS.1": ("住所 青森県青空市緑町1-2-3 です", "青森県青空市緑町1-2-3", "住所 青森県青空の緑町 です"),
    "ja.DATE_OF_BIRTH.1": ("生年月日：1990年2月3日 です", "1990年2月3日", "製造日：1990年2月3日 です"),
    "ja.MY_NUMBER.1": ("番号 1234 5678 9018 です", "1234 5678 9018", "番号 1234 5678 9012 です"),
    "ja.COMPANY_NAME.1": ("株式会社青空 です", "株式会社青空", "株式会社が です"),
    "ja.COMPANY_NAME.2": ("月光銀行 へ", "月光銀行", "銀行 へ"),
    "ja.EMPLOYEE_ID.1": ("社員番号：A-123 です", "A-123", "電話番号：A-123 です"),
    "ja.EMPLOYEE_ID.2": ("会員番号：A-123 です", "A-123", "整理番号：A-123 です"),
    "ja.PROJECT_NAME.1": ("案件名：青空 です", "青空", "物件名：青空 です"),
    "ja.PROJECT_NAME.2": ("案件「青空」は", "青空", "条件「青空」は"),
    "ja.PERSON.1": ("そこで白石さん と", "白石", "そこで総務部さん と"),
    "ja.PERSON.2": ("そこの佐藤花子 が", "佐藤花子", "そこの佐藤市 が"),
    "ja.PERSON.3": ("そこの林花子 が", "林花子", "そこの林花 が"),
    "ja.PERSON.4": ("ジョン・スミス が", "ジョン・スミス", "ジョン スミス が"),
    "ja.PERSON.5": ("そこのスミスさん が", "スミス", "そこのスミスくん が"),
    "ja.PERSON.6": ("氏名：タナカ ハナコ", "タナカ ハナコ", "品名：タナカ ハナコ"),
    "ja.PERSON.7": ("氏名：白石花子", "白石花子", "品名：白石花子"),
    "ja.PHONE.2": ("電話 0312345678 まで", "0312345678", "電話 1312345678 まで"),
    "ja.PERSON.8": ("そこの佐藤 が", "佐藤", "そこの佐藤町 が"),
    "ja.POSTAL_CODE.2": ("番号 100-0001 は", "100-0001", "番号 100-00011 は"),
    "zh.PHONE.1": ("电话 13812345678。", "13812345678", "电话 12812345678。"),
    "zh.PHONE.2": ("电话 010-66554433。", "010-66554433", "电话 110-66554433。"),
    "zh.RESIDENT_ID.1": ("身份证 11010519491231002X。", "11010519491231002X", "身份证 110105194912310021。"),
    "zh.POSTAL_CODE.1": ("邮编：100001。", "100001", "邮箱：100001。"),
    "zh.DATE_OF_BIRTH.1": ("出生日期：1990年2月3日。", "1990年2月3日", "生产日期：1990年2月3日。"),
    "zh.ADDRESS.1": ("江西省青山市蓝天区绿水路12号。", "江西省青山市蓝天区绿水路12号", "江西省青山市蓝天区绿水路号。"),
    "zh.COMPANY_NAME.1": ("蓝天商行有限公司。", "蓝天商行有限公司", "蓝天商行有限责任。"),
    "zh.EMPLOYEE_ID.1": ("工号：A-123。", "A-123", "批号：A-123。"),
    "zh.PROJECT_NAME.1": ("项目名称：蓝天。", "蓝天", "栏目名称：蓝天。"),
    "zh.PROJECT_NAME.2": ("项目“蓝天”已", "蓝天", "栏目“蓝天”已"),
    "zh.EMPLOYEE_ID.2": ("客户编号：A-123。", "A-123", "商品编号：A-123。"),
    "zh.PERSON.1": ("见 王小明先生。", "王小明", "见 天小明先生。"),
    "zh.PERSON.2": ("联系人：李小红。", "李小红", "联系部：李小红。"),
    "zh.PERSON.3": ("见 王小明。", "王小明", "见 王小明天空。"),
    "zh.POSTAL_CODE.2": ("在 100001。", "100001", "在 900001。"),
}
