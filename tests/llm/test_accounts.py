"""Bank accounts followed by short upper-case words."""
from dealflow.llm import pii


def accounts(text):
    return [text[a:b] for kind, a, b, _ in pii.find(text) if kind == "iban"]


def test_account_before_an_upper_case_word():
    for number in ("BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332",
                   "SE45 5000 0000 0583 9825 7466", "PL61 1090 1014 0000 0712 1981 2874"):
        for tail in ("", " BIC GKCCBEBB", " X", " SWIFT", " ABCD EFGH 12", " ABCD", ".", " BIC"):
            assert accounts(f"IBAN {number}{tail}") == [number], (number, tail)


def test_lengths_that_are_no_multiple_of_four():
    for number in ("DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606", "NO93 8601 1117 947",
                   "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"):
        for tail in ("", " BIC", " ABCD"):
            assert accounts(f"{number}{tail}") == [number], (number, tail)


def test_wrong_numbers_and_glued_letters_stay_out():
    assert accounts("IBAN BE68 5390 0754 7035 BIC") == []
    assert accounts("IBAN BE68539007547034BIC") == []
    assert accounts("IBAN BE68 5390 0754 7034x") == []


def test_two_accounts_in_a_row():
    assert accounts("BE68 5390 0754 7034 DE89 3704 0044 0532 0130 00") == ["BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00"]
