"""talkprint.functions"""
