"""talkprint.streaming"""
