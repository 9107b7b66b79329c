import talkprint


def test_every_export_is_there():
    assert len(set(talkprint.__all__)) == len(talkprint.__all__) and sorted(talkprint.__all__) == talkprint.__all__
    assert all(getattr(talkprint, name) is not None for name in talkprint.__all__)
    assert len(talkprint.FEATURES) == 19 and callable(talkprint.fingerprint) and callable(talkprint.read_dialogs)
